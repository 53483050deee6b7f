"""Texts that stop before their file did.

What may stand behind a break (white space, dots, a note of the transfer, a broken character) is taken
off. A rest that is a strict prefix of a longer one was cut. Texts are compared by hashes of prefixes of
fixed lengths (``bounds``): one pass gives the 128-bit hash of every such prefix of a text and of the
text itself, and texts stay where they are. Where the last fixed prefix of one text is also one of
another, the lengths between it and the next fixed one at which texts end are kept as 256 bits, and only
texts that have such a prefix are read again, to hash their prefixes of just these lengths. So every text
is compared with all that carry it on; one that does so inside the line is enough. The same test by prefix
is made for last words: a last word that hardly occurs as a word of its own but is a strict prefix of a
common one was cut. Most cut texts have no longer copy; these are found by the grammar of their own
end (``endings``), with the test of words where the grammar leaves it open.

Defined results: null and empty texts, and texts of nothing but what may follow a break, are whole; a
text that a longer copy carries on at a line break is judged by its grammar alone; so is one that is only
carried on to the end of the line, where that may be an edit of the last line: the longer copy adds a
sentence or statement after a whole one, or a copy of the shorter one ends its line there; repeated rows and
documents without an id are each judged alike. The counts of words and of last lines are over all
documents; a last line that many texts share, near copies counted once, is a phrase and no break, unless a
blank or a last word that stands nowhere else tells otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from struct import unpack

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtree.llm.endings import ending
from voxtree.session import materialize

#: What transfers and field limits put behind a break.
_NOTE = r"cut|truncated|truncation|snip|snipped|clipped|incomplete|connection (?:closed|reset|lost)|timed? ?out|eof|end of data|read more|more|continued"
AFTER = rf"(?i)(?<!\s)(?:[\s\x{{FFFD}}…]++|\.{{3}}|\[(?:{_NOTE})[^\]\n]{{0,30}}\]|<(?:{_NOTE})[^>\n]{{0,30}}>|\((?:{_NOTE})[^)\n]{{0,30}}\))++\z"
#: Texts of fewer characters are prefixes of others by chance.
LEAST = 20
#: Most characters between two fixed prefixes.
BLOCK = 256
#: The end of a text that is looked at first for what follows a break, and the least that must remain of it: more than one note.
_END, _REST = 200, 64
#: What ends a sentence or statement.
_WHOLE = ".!?;}。！？"
#: A last line is a phrase from so many texts on that aren't near copies, and from this share of all texts on.
ALIKE, SHARE = 3, 0.0002
_SCHEMA = (
    "doc_id bigint, mark bigint, hi bigint, lo bigint, size int, tail int, verdict string, word string, phrase boolean, line_hi bigint, line_lo bigint, near bigint, blank boolean, broken boolean, "
    "his array<bigint>, los array<bigint>"
)
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
#: A compound word that stops with the first letter of its next part.
_HUMP = re.compile(r"[A-Z][a-z]+[A-Z]\Z")
#: Words: letters without case changes, of any script. A last word of capitals alone is one too.
WORD = r"[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}{2,}"


def bounds(size: int) -> list[int]:
    """The lengths of the fixed prefixes of a text of so many characters."""
    return [n for n in (LEAST, 32, 64, 128) if n <= size] + list(range(BLOCK, size + 1, BLOCK))


def _goes_on(text: str, size: int, last_break: int) -> int:
    """How a text goes on behind its first characters: 2 inside the line and to a later one, 1 inside the
    line, whose end is the text's, and inside a word, string, statement or sentence, 0 otherwise."""
    if text[size] in "\r\n":
        return 0
    if last_break >= size:
        return 2
    return 0 if text[size] in " \t" and text[size - 1] in _WHOLE else 1


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _identity(text: str) -> tuple[int, int]:
    return unpack("<qq", blake2b(_bytes(text), digest_size=16).digest())


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _last_word(text: str) -> str | None:
    """The last word, if the text stops in one."""
    def kind(c: str) -> int:
        return 0 if not c.isalpha() else 2 if c.isupper() else 1

    n, which = len(text), kind(text[-1:] or " ")
    at = n
    while at and which and kind(text[at - 1]) == which:
        at -= 1
    return text[at:] if which == 1 or (which == 2 and n - at > 1) else None


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: what its end tells, and the hashes of its fixed prefixes."""
    for batch in batches:
        out = []
        for doc, mark, body, blank, broken in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "body", "blank", "broken")), strict=True):
            size, whole, his, los, done = len(body), blake2b(digest_size=16), [], [], 0
            for n in bounds(size):
                whole.update(_bytes(body[done:n]))
                done = n
                hi, lo = unpack("<qq", whole.digest())
                his.append(hi)
                los.append(lo)
            whole.update(_bytes(body[done:]))
            verdict = ending(body)
            if verdict in ("word", "line") and _HUMP.search(body[-_END:]):
                verdict = "open"
            line = body[body.rfind("\n") + 1 :].strip()
            # near copies with another head have as many characters, or as many lines and the same text before the last one
            near = _identity(f"{body.count('\n')} {body[: size - len(line)][-_END:]}")[0] if verdict == "line" else None
            out.append((doc, mark, *unpack("<qq", whole.digest()), size, size - done, verdict, _last_word(body[-10 * _END :]), " " in line, *_identity(line), near, blank, broken, his, los))
        yield _batch(_SCHEMA, out)


_CARRIED = "hi bigint, lo bigint, how int"


def _carried_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, places: the fixed prefixes and the bits of the lengths behind them) → hash of each of these
    prefixes of the body, and how the body goes on behind it."""
    for batch in batches:
        out = []
        for body, places in zip(batch["body"].to_pylist(), batch["places"].to_pylist(), strict=True):
            state, done, size = blake2b(digest_size=16), 0, len(body)
            fixed, last_break = bounds(size), body.rfind("\n")
            for place in sorted(places, key=lambda p: p["k"]):
                if place["k"] >= len(fixed):
                    break
                at = fixed[place["k"]]
                state.update(_bytes(body[done:at]))
                done = at
                bits = sum((place[f"b{i}"] & (2**64 - 1)) << (64 * i) for i in range(4))
                while bits:
                    n = at + (bits & -bits).bit_length() - 1
                    bits &= bits - 1
                    if n >= size:
                        break
                    if how := _goes_on(body, n, last_break):
                        prefix = state.copy()
                        prefix.update(_bytes(body[at:n]))
                        out.append((*unpack("<qq", prefix.digest()), how))
        yield _batch(_CARRIED, out)


def body_of(text: Column) -> Column:
    """The text without what stands behind a break. The pattern only sees the last characters, unless
    so little of them remains that a note may begin before them."""
    end = F.regexp_replace(F.right(text, F.lit(_END)), AFTER, "")
    short = F.concat(F.left(text, F.greatest(F.length(text) - _END, F.lit(0))), end)
    return F.when((F.length(end) >= _REST) | (F.length(text) <= _END), short).otherwise(F.regexp_replace(text, AFTER, ""))


def _bodies(documents: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the whole text), text and body."""
    texts = documents.where("text is not null and text <> ''").select("doc_id", "text")
    return texts.select("doc_id", F.xxhash64("text").alias("mark"), "text", body_of(F.col("text")).alias("body")).where("body <> ''")


def carried_on(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """hi, lo (of bodies that a longer one carries on), how (2: to a later line, 1: to the end of its line) and
    edited (a copy ends its line where the text does)."""
    # copies of a text are one from here on
    distinct = materialize(
        facts.where(f"size >= {LEAST}").groupBy("hi", "lo")
        .agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.max("broken").alias("edited"), F.first("tail").alias("tail"), F.first("his").alias("his"), F.first("los").alias("los"))
    )
    bits = [F.expr(f"if(k = size(his) - 1 and tail div 64 = {i}, shiftleft(1L, tail % 64), 0L) as b{i}") for i in range(4)]
    parts = distinct.select("lo", "tail", "his", F.posexplode(F.arrays_zip("his", "los")).alias("k", "p")).select(F.col("p.his").alias("hi"), F.col("p.los").alias("lo"), F.col("lo").alias("body"), *bits)
    met = (
        parts.groupBy("hi", "lo").agg(F.min("body").alias("a"), F.max("body").alias("b"), *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])
        .where("a <> b and (b0 | b1 | b2 | b3) <> 0").drop("a", "b")
    )
    again = distinct.select("one", F.posexplode(F.arrays_zip("his", "los")).alias("k", "p")).select("one", "k", F.col("p.his").alias("hi"), F.col("p.los").alias("lo"))
    # as many places for a text as it has fixed prefixes
    wanted = materialize(
        again.join(met, ["hi", "lo"]).groupBy("one").agg(F.collect_list(F.struct("k", "b0", "b1", "b2", "b3")).alias("places")).select(F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("mark"), "places")
    )
    longer = _bodies(documents).join(wanted, "mark").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("body", "places").mapInArrow(_carried_on, _CARRIED)
    return longer.groupBy("hi", "lo").agg(F.max("how").alias("how")).join(distinct.select("hi", "lo", "edited"), ["hi", "lo"])


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _start(word: Column, size: Column) -> Column:
    """What stands for the first ``size`` letters: themselves, or their hash where they are many."""
    start = F.substring(word, F.lit(1), size)
    return F.when(size <= 64, start).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(start))))


def cut_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Of ``words`` (word) those that were cut, and in how many documents each occurs (own): strict prefixes
    of a word that occurs in at least five documents, and in five times as many as the word itself."""
    counts = materialize(texts.select(F.explode(_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    starts = counts.where("n >= 5 and length(w) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: _start(F.col("w"), k))).alias("start"), "n")
    longer = starts.groupBy("start").agg(F.max("n").alias("longer"))
    asked = words.select("word").distinct().withColumn("start", _start(F.col("word"), F.length("word"))).join(longer, "start")
    own = counts.select(F.col("w").alias("word"), "n")
    return asked.join(own, "word", "left").where(F.col("longer") >= 5 * F.coalesce("n", F.lit(1))).select("word", F.coalesce("n", F.lit(0)).alias("own"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, evidence (prefix, grammar, blank, word, line or null for a whole text) of every document with a
    text."""
    # a blank after the last word, on the same line to the end: the next word is missing
    rest = F.expr("substring(text, length(body) + 1)")
    bodies = _bodies(documents).select("doc_id", "mark", "body", (rest.rlike(r"^[ \t]") & ~rest.contains("\n")).alias("blank"), rest.rlike(r"\A\s*\n\s*\z").alias("broken"))
    rows = materialize(bodies.mapInArrow(_facts, _SCHEMA))
    longer = carried_on(documents, rows)
    rows = rows.drop("mark", "tail", "his", "los", "broken").join(longer, ["hi", "lo"], "left")

    texts = documents.where("text is not null and text <> ''").select("text")
    cut = cut_words(texts, rows.where("verdict in ('word', 'line') and word is not null")).withColumn("cut", F.lit(True))
    # a last line of several words that different texts share is a phrase, not a break
    all_texts = rows.agg(F.count(F.lit(1)).alias("texts"))
    shared = (
        rows.where("verdict = 'line' and phrase").groupBy("line_hi", "line_lo").agg(F.count_distinct("size").alias("sizes"), F.count_distinct("near").alias("n"), F.count(F.lit(1)).alias("ends")).where(f"sizes >= {ALIKE} and n >= {ALIKE}")
        .join(F.broadcast(all_texts), F.expr(f"n >= {SHARE} * texts")).select("line_hi", "line_lo", F.lit("line").alias("verdict"), F.lit(True).alias("shared"), "ends")
    )
    # in a phrase a last word that also stands elsewhere is whole, be it the start of a common one ("on", "one") or not
    half = F.col("cut") & F.col("verdict").isin("word", "line") & (F.col("shared").isNull() | ~F.col("phrase") | (F.col("own") <= F.col("ends")))
    evidence = (
        F.when((F.col("how") == 2) | ((F.col("how") == 1) & ~F.col("edited")), "prefix").when(F.col("verdict") == "open", "grammar").when(F.col("blank") & F.col("verdict").isin("word", "line"), "blank")
        .when(half, "word").when(F.col("shared") & F.col("phrase"), None).when(F.col("verdict") == "line", "line")
    )
    return rows.join(cut, "word", "left").join(shared, ["line_hi", "line_lo", "verdict"], "left").select("doc_id", evidence.alias("evidence"))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id and evidence of the texts that break off."""
    return judged(documents).where("evidence is not null")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, n_documents, n_truncated and share; a null source is its own."""
    found = truncated(documents).select("doc_id", F.lit(1).alias("cut")).distinct()
    return (
        documents.select("doc_id", "source").join(found, "doc_id", "left").groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count("cut").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_documents"))
    )
