"""What is read and written, and the rules and settings that say how."""
