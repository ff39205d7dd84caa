"""Personal data: what patterns find, and the terms that disclose it.

Information-theoretic sanitisation. Every value that the patterns find (an e-mail address, an IP address, a card's or a
phone's number) is a protected entity. Terms (runs of three or more letters, digits or underscores, lower-cased) that lie
whole within REACH code points of an entity co-occur with it. Over all documents,

    information(entity)     = log2(words / occurrences of the entity)
    disclosure(entity, term) = log2(words * together / (occurrences of the entity * occurrences of the term)) / information

so 1 means that a term is only ever seen beside its entity. Terms of SUPPORT or more different surroundings (copies of a
passage count once) whose disclosure reaches DISCLOSURE are spans of the kind `term` wherever they occur outside other spans.
They are generalised to the longest of their beginnings, of three letters or more, that discloses none of these entities, and
removed if there is none.

Surroundings are bounded, so pairs grow with the entities found and never with the square of a text. Tables that are sent to
executors are sent in parts of PART rows, with a pass over the texts each; where no term has support, there is no pass.

Null texts are empty and hold nothing; rows that repeat a text get equal spans, and each counts as an occurrence; a null or a
repeated id changes nothing, as ids aren't read; empty tables give no rows; a column that has the name of a new one is
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import SLICE, append_by_arrow, cut

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
REACH = 80
SUPPORT = 3
DISCLOSURE = 0.95
#: Letters that a term or its generalised form has at least.
LEAST = 3
PART = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w{%d,}" % LEAST)

Span = tuple[int, int, int]  # start, kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain. Each is found from its @, as tries from every letter of a long word would
    take the square of its length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _DOTTED.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> int:
    """One number for all ways to write a value."""
    plain = value.lower() if kind == 0 else value if kind == 1 else digits_of(value)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}") - 2**63


def masked(text: str, spans: list[Span]) -> str:
    """text with blanks for the spans."""
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            out += [text[at:start], " " * (end - max(at, start))]
            at = end
    return "".join([*out, text[at:]])


def around(plain: str, start: int, end: int) -> list[str]:
    """The terms that lie whole within REACH code points before and after a span, each once, in order."""
    low, high = max(0, start - REACH), min(len(plain), end + REACH)
    while 0 < low < start and _word(plain[low - 1]) and _word(plain[low]):
        low += 1
    while end < high < len(plain) and _word(plain[high - 1]) and _word(plain[high]):
        high -= 1
    return list(dict.fromkeys(x.lower() for x in _WORD.findall(plain, low, high)))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def contexts(docs: DataFrame, text_col: str) -> DataFrame:
    """(entity, context, terms, n): surroundings of every entity, equal ones once, with the number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            entities, keys, terms = [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                plain = masked(text, spans) if spans else ""
                for start, kind, end in spans:
                    near = around(plain, start, end)
                    entities.append(entity(kind, text[start:end]))
                    keys.append(xxhash.xxh64_intdigest(" ".join(near)) - 2**63)
                    terms.append(near)
            yield pa.record_batch({"entity": pa.array(entities, pa.int64()), "context": pa.array(keys, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string()))})

    found = docs.select(text_col).mapInArrow(run, "entity long, context long, terms array<string>")
    return found.groupBy("entity", "context").agg(F.first("terms").alias("terms"), F.count("*").alias("n"))


def forms(term: str) -> list[str]:
    """A term and its beginnings, longest first; these end with *."""
    return [term, *(f"{term[:k]}*" for k in range(len(term) - 1, LEAST - 1, -1))]


def occurrences(docs: DataFrame, text_col: str, asked: DataFrame) -> tuple[DataFrame, int]:
    """(form, n): how often each asked form occurs in all texts, outside of spans; and the number of all words."""
    found, words = None, None
    for part in parts_of(asked, "form"):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.form for r in part.select("form").collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            first = {x[:LEAST] for x in wanted}
            counts: Counter[str] = Counter()
            for text in (x.as_py() or "" for b in batches for x in b.column(0)):
                seen = Counter(map(str.lower, _WORD.findall(masked(text, base_spans(text)))))
                counts[""] += seen.total()
                for word, n in seen.items():
                    if word[:LEAST] in first:
                        for form in forms(word):
                            if form in wanted:
                                counts[form] += n
            yield pa.record_batch({"form": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        counted = cut(docs.select(text_col).mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")))
        words = words or counted.where("form = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        own = counted.where("form <> ''")
        found = own if found is None else found.unionByName(own)
    return found, words


def parts_of(df: DataFrame, key: str) -> list[DataFrame]:
    """df in parts of about PART rows."""
    n = -(-df.count() // PART)
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """(term, general): the terms that disclose an entity, with the form that they are generalised to (null: removed). None, if
    no term has support."""
    seen = cut(contexts(docs, text_col))
    pairs = seen.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("support"))
    pairs = cut(pairs.where(F.col("support") >= SUPPORT).select("entity", "term"))
    if pairs.isEmpty():
        return None
    lengths = F.sequence(F.length("term") - 1, F.lit(LEAST), F.lit(-1))
    beginnings = F.when(F.length("term") > LEAST, F.transform(lengths, lambda k: F.concat(F.substring("term", F.lit(1), k), F.lit("*")))).otherwise(F.array())
    every = F.explode(F.concat(F.array("term"), beginnings)).alias("form")
    asked = cut(pairs.select("entity", "term", every))
    counted, words = occurrences(docs, text_col, asked.select("form").distinct())
    # how often each asked form stands beside its entity
    near = seen.join(pairs.select("entity").distinct(), "entity", "left_semi").select("entity", "context", "n", F.explode("terms").alias("term"))
    near = near.select("entity", "context", "n", every).distinct().join(asked.select("entity", "form").distinct(), ["entity", "form"], "left_semi")
    near = near.groupBy("entity", "form").agg(F.sum("n").alias("together"))
    of = seen.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    judged = asked.join(near, ["entity", "form"]).join(of, "entity").join(counted, "form")
    information = F.log2(F.lit(float(words)) / F.col("n_entity"))
    shared = F.log2(F.lit(float(words)) * F.least("together", "n") / (F.col("n_entity") * F.col("n")))
    judged = judged.withColumn("discloses", (shared >= DISCLOSURE * information) & (information > 0))
    # a form is safe for a term if it discloses none of the entities that the term does
    guilty = judged.where("form = term and discloses").select("entity", "term")
    by_form = judged.join(guilty, ["entity", "term"], "left_semi").groupBy("term", "form").agg(F.max("discloses").alias("discloses"))
    longest = F.max(F.when(~F.col("discloses"), F.struct(F.length("form").alias("size"), "form")))
    return cut(by_form.groupBy("term").agg(longest["form"].alias("general")))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("general", T.StringType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("general", pa.string())]))


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs's columns `keep` (all, if None) and `spans`, by start, then kind: kind, start, end (code points, end exclusive) and, for
    terms, the form that they are generalised to."""
    terms = disclosing_terms(docs, text_col)
    parts = parts_of(terms, "term") if terms is not None else []
    shared = [docs.sparkSession.sparkContext.broadcast(dict(p.collect())) for p in parts]

    def build() -> Callable[[list[pa.Array]], list[pa.Array]]:
        general = {t: g for part in shared for t, g in part.value.items()}

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for text in columns[0]:
                text = text.as_py() or ""
                spans = [(s, k, e, None) for s, k, e in base_spans(text)]
                if general:
                    plain = masked(text, [x[:3] for x in spans])
                    if not general.keys().isdisjoint(map(str.lower, _WORD.findall(plain))):
                        words = ((m, m[0].lower()) for m in _WORD.finditer(plain))
                        spans = sorted(spans + [(m.start(), TERM, m.end(), general[w]) for m, w in words if w in general], key=lambda x: x[:3])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "general": g} for s, k, e, g in spans])
            return [pa.array(out, _ARROW)]

        return compute

    return append_by_arrow(docs, [T.StructField("spans", SPANS)], build, [text_col], keep=keep)


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """detect's rows and `sanitised`: <kind> for what the patterns found (for overlapping ones, once), the general form for
    terms that have one, nothing for the others."""

    def build() -> Callable[[list[pa.Array]], list[pa.Array]]:
        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for text, spans in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True):
                done, at = [], 0
                for x in spans if text else []:
                    if x["start"] >= at:
                        done += [text[at : x["start"]], (x["general"] or "") if x["kind"] == KINDS[TERM] else f"<{x['kind']}>"]
                    at = max(at, x["end"])
                done.append((text or "")[at:])
                out.append("".join(done))
            return [pa.array(out, pa.string())]

        return compute

    return append_by_arrow(found, [T.StructField("sanitised", T.StringType())], build, [text_col, "spans"])
