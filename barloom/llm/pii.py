"""Personal data: patterns for known kinds, and contexts learned from what these find.

Identifiers that the base patterns find are seeds. The cue before a seed - the word before it, or the part
of its own word up to a `=`, `:` or `#` - is a lexical pattern. Patterns and the identifiers they introduce form a graph.
A pattern is as sure as the share of all its uses in the corpus that introduce an identifier held to be
one; an identifier is held to be one if it is a seed or follows a sure pattern. So identifiers that a sure pattern finds
support further patterns, which find more. Spark scores the graph until no new pattern becomes sure. Unseen identifiers
behind sure patterns become further spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import batch, stored, texts, unused

KINDS = ("email", "ip", "card", "phone")
# Each reads a text in time linear in its length. A number that starts no address within a run of digits starts none later in it.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# An address is read from its @ on, and from there back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# One more kind of seed: a long hexadecimal word with both letters and digits.
SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}+(?![A-Za-z0-9])")
# What may be an identifier: a word part with a digit, from 6 characters on.
CANDIDATE = re.compile(r"[A-Za-z0-9@._%+/-]{6,}")
# A word part of more characters than this is named by a hash as a cue.
LONG = 80
GLUED = re.compile(r"\S*[=:#]")
# A pattern is sure from this share of its uses on, and with this many distinct identifiers held to be such.
SURE = 0.8
SUPPORT = 5
# Cues counted in a task before they are handed on.
CUES = 200_000
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in text.split(".")))
    digits = _NO_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from left to right, none overlapping; each character is read at most twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; a match that is not valid is dropped."""
    kinds = [] if not _DIGIT.search(text) else ["ip", "card"] + ["phone"] * ("+" in text)
    found = [(m.start(), m.end(), k) for k in kinds for m in PATTERNS[k].finditer(text) if _valid(k, m[0])]
    found += [(a, b, "email") for a, b in emails(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def cue(text: str, start: int, far: Far | None = None) -> str | None:
    """The pattern before a place: s:WORD for the word before, g:PART (or h: and its hash, if it is long) for what is glued to it."""
    before = text[max(0, start - LONG) : start]
    if start > LONG and not any(c.isspace() for c in before.rstrip()):
        return (far or Far(text)).cue(start)
    if before and not before[-1].isspace():
        part = before.split()[-1]
        return "g:" + part.lower() if part[-1] in "=:#" else None
    words = before.split()
    return "s:" + words[-1].lower() if words else None


def glued(word: str) -> dict[int, str]:
    """The cues a word holds, by where they end; each character is read once."""
    out, at, digest = {}, 0, hashlib.blake2b(digest_size=16)
    for m in re.finditer("[=:#]", word):
        digest.update(word[at : m.end()].lower().encode("utf-8", "surrogatepass"))
        at = m.end()
        out[at] = "g:" + word[:at].lower() if at <= LONG else "h:" + digest.hexdigest()
    return out


class Far:
    """Cues of the places of one text whose word, or the word before, begins far before them."""

    def __init__(self, text: str):
        self.text = text
        self.last: tuple[int, dict[int, str]] = (-1, {})

    @cached_property
    def words(self) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in re.finditer(r"\S+", self.text)]
        return [a for a, _ in spans], [b for _, b in spans]

    def cue(self, start: int) -> str | None:
        starts, ends = self.words
        k = bisect_left(starts, start) - 1
        if k < 0:
            return None
        if ends[k] < start or self.text[start - 1].isspace():
            return "s:" + self.text[starts[k] : ends[k]].lower()
        if self.last[0] != k:
            self.last = k, glued(self.text[starts[k] : ends[k]])
        return self.last[1].get(start - starts[k])


def cues(text: str) -> list[str]:
    """All cues a text has, as `cue` would name them."""
    words = text.split()
    out = ["s:" + w.lower() for w in words]
    if "=" in text or ":" in text or "#" in text:
        for w in words:
            if len(w) > LONG:
                out += [name for end, name in glued(w).items() if end < len(w)]
            elif "=" in w or ":" in w or "#" in w:
                w = w.lower()
                out += ["g:" + w[: i + 1] for i, c in enumerate(w[:-1]) if c in "=:#"]
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None, str, int]]:
    """(start, end, kind of the seed or None, cue, weight) of all places with a cue that hold or may hold an identifier.

    A word part around a seed is one more identifier; where both start together they are one use of the cue, so it weighs nothing.
    """
    if not base and not _DIGIT.search(text):
        return []
    seeds = sorted([*base, *((m.start(), m.end(), "secret") for m in SECRET.finditer(text))])
    begun = {a for a, _, _ in seeds}
    far = Far(text)
    out, k, reach = [(a, b, kind, cue(text, a, far), 1) for a, b, kind in seeds], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip(".,-/"))
        while k < len(seeds) and seeds[k][0] <= a:
            reach = max(reach, seeds[k][1])
            k += 1
        if b - a >= 6 and reach < b and _DIGIT.search(text, a, b):
            out.append((a, b, None, cue(text, a, far), int(a not in begun)))
    return [c for c in out if c[3]]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_SCAN = ("doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
         "found array<struct<start:long,end:long,kind:string,cue:string,instance:long,weight:long>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and places with a cue, one row per row of `docs`, without a shuffle."""
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("cue", pa.string()), ("instance", pa.int64()), ("weight", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("base", pa.string()), ("found", found)])

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                n = Counter(k for _, _, k in base)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base), [
                    {"start": s, "end": e, "kind": k, "cue": c, "instance": _number(text[s:e]), "weight": w} for s, e, k, c, w in candidates(text, base)]))
            yield batch(schema, b.column(0), b.column(2), *([r[k] for r in rows] for k in range(7)))

    rows = texts(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, _SCAN)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def cue_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """cue, uses: how often each cue stands in the whole corpus; counted in tasks before the shuffle."""
    schema = pa.schema([("cue", pa.string()), ("uses", pa.int64())])

    def run(batches):
        count: Counter[str] = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                count.update(cues(text or ""))
                if len(count) > CUES:
                    yield batch(schema, list(count), list(count.values()))
                    count.clear()
        yield batch(schema, list(count), list(count.values()))

    rows = texts(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, "cue string, uses long").groupBy("cue").agg(F.sum("uses").alias("uses"))


def graph(scanned: DataFrame, counts: DataFrame, sure: float = SURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Edges cue, instance, n (uses), kind (of the seed) and uses of the cue; and instance, kind of the seeds.

    Only cues that would be sure if all they introduce were identifiers have edges; no other can become sure.
    """
    place = scanned.select(F.explode("found").alias("f")).select("f.cue", "f.instance", "f.kind", "f.weight")
    edge = place.groupBy("cue", "instance").agg(F.sum("weight").alias("n"), F.min("kind").alias("kind"))
    able = edge.groupBy("cue").agg(F.count("*").alias("instances"), F.sum("n").alias("n")).where(F.col("instances") >= support)
    able = able.join(counts, "cue").where(F.col("n") >= sure * F.col("uses")).select("cue", "uses")
    seeds = stored(edge.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind")))
    return stored(edge.join(able, "cue")), seeds


def scored(edge: DataFrame, held: DataFrame) -> DataFrame:
    """cue, kind, confidence, support: one round of scoring by the identifiers held to be such (instance, kind).

    kind is that of most of a cue's identifiers (ties: the first by name), support their number.
    """
    per_kind = edge.drop("kind").join(held, "instance").groupBy("cue", "kind").agg(
        F.count("*").alias("m"), F.sum("n").alias("sum"), F.max("uses").alias("uses"))
    return per_kind.groupBy("cue").agg(
        F.min_by("kind", F.struct(-F.col("m"), "kind")).alias("kind"),
        F.least(F.lit(1.0), F.sum("sum") / F.max("uses")).alias("confidence"), F.sum("m").alias("support"))


def sure_patterns(scanned: DataFrame, counts: DataFrame, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """cue, kind, confidence of the sure patterns, scored in rounds until no new one becomes sure.

    What a sure pattern introduces is held to be an identifier in the next round, of the kind of the most confident such pattern (then
    the first by name). Identifiers only become more, so a pattern stays sure and the rounds end.
    """
    edge, seeds = graph(scanned, counts, sure, support)
    held, known = seeds, -1
    while True:
        found = stored(scored(edge, held).where((F.col("confidence") >= sure) & (F.col("support") >= support)).drop("support"))
        now = found.count()
        if now == known or not now:
            return found
        known = now
        reached = edge.select("cue", "instance").join(found, "cue").select("instance", F.col("confidence").alias("s"), "kind")
        both = seeds.select("instance", "kind", F.lit(2.0).alias("s")).unionByName(reached.select("instance", "kind", "s"))  # seeds first
        held = stored(both.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("s"), "kind")).alias("kind")))


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_hash, more: the spans behind sure patterns that the base does not have, in order."""
    # Ids may be null or repeated; the same id and text are the same document.
    place = scanned.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("found").alias("f")).select("doc_id", "text_hash", "f.*")
    new = place.where("kind IS NULL OR kind = 'secret'").join(patterns.select("cue", F.col("kind").alias("as_kind")), "cue")
    span = F.struct("start", "end", F.coalesce("kind", "as_kind").alias("kind"))
    return new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Personal data of each row of `docs`.

    doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base and spans (text: kind:start:end, joined by commas), more (the
    discovered spans) and n_found (their number). A null text is an empty one; a null doc_id stays null; repeated rows give repeated
    rows. What a document holds is bounded by its length.
    """
    scanned = stored(scan(docs, id_col, text_col))
    patterns = sure_patterns(scanned, cue_counts(docs, text_col), **options)
    more = discovered(scanned, patterns)
    m = more.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "more")
    both = scanned.join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("text_hash").eqNullSafe(F.col("m_hash")), "left")
    order = F.array(*(F.lit(k) for k in (*KINDS, "secret")))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"), F.array_position(order, F.split(s, ":")[0]).alias("rank"), F.split(s, ":")[2].cast("long").alias("end"), F.split(s, ":")[0].alias("kind")))
    extra = F.transform(F.coalesce("more", F.array().cast("array<struct<start:long,end:long,kind:string>>")), lambda s: F.struct(
        s.start.alias("start"), F.array_position(order, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, extra)), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return both.select("doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "more", F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"), spans.alias("spans"))


def masked(text: str | None, more: list[tuple[int, int, str]]) -> str | None:
    """The text with each base and further span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at, last = [], 0, None
    for a, b, kind in sorted([*base_spans(text), *more], key=lambda s: (s[0], -s[1])):
        if last is not None and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at, last = b, kind
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """`docs` with personal data masked in the text; all rows and columns stay. A null text stays null.

    `length_col`, where `docs` has it and its text changes, becomes the text's new length.
    """
    scanned = stored(scan(docs, id_col, text_col))
    patterns = sure_patterns(scanned, cue_counts(docs, text_col), **options)
    own_id, own_hash, own_more = (unused(docs, c) for c in ("found_id", "found_hash", "found_more"))
    more = discovered(scanned, patterns).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("more").alias(own_more))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col(own_hash))
    both = docs.join(more, same, "left").select(*docs.columns, own_more)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for b in batches:
            spans = [[(s["start"], s["end"], s["kind"]) for s in m or ()] for m in b.column(b.num_columns - 1).to_pylist()]
            text = [masked(t, m) for t, m in zip(b.column(at).to_pylist(), spans, strict=True)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            if length is not None:
                known, was = columns[length].to_pylist(), b.column(at).to_pylist()
                columns[length] = pa.array([n if t == o else len(t) for n, t, o in zip(known, text, was, strict=True)], columns[length].type)
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)
