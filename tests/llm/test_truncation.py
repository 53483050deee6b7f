import pytest

from voxtree.llm.endings import ending, kind_of
from voxtree.llm.truncation import body_of, judged, truncated, truncation_rates

CODE = "int walk(int a) {\n    return widget(a, \"text\");\n}\n\n"
PY = "def walk(a):\n    widget = widgets(a)\n    return widget\n\n"
PROSE = "The widget is kept. Callers must walk the widget before they resolve the record.\n"


@pytest.mark.parametrize(
    "text,verdict",
    [(CODE, "ends"), (CODE + "int wa", "open"), (CODE + "int walk(int b", "open"), (CODE + 'int walk() {\n  log("unend', "open"), (CODE + "// a note that", "open"), (CODE + "// a note.", "ends"), (CODE + "/* never", "open"), ('#include "a.h"\nint b;\n#include "c.h"', "ends"),
     (PY, "word"), (PY + "def walk(", "open"), (PY + "x = [1,", "open"), (PY + "x = 1 +", "open"), (PY + "x = 'abc", "open"), (PY + "for x in", "open"), (PY + "    wid", "open"), (PY + "walk(3)", "ends"),
     (PROSE, "ends"), (PROSE + "Do not walk the wid", "line"), ("<html><body><p>Whole.</p></body></html>", "ends"), ("<html><p>Not who", "open"), ("<html><p>Whole.</p><di", "open"), ('{"a": [1, 2], "b": "c"}', "ends"), ('{"a": [1, 2], "b', "open"),
     ("key:\n  sub: 1\n  note: a whole one.\n", "ends"), ("key:\n  sub: 1\n  note: a broken", "open"), ("key:\n  su", "open"), ("#!/bin/sh\nif x; then\n  echo 1\nfi\n", "word"), ("#!/bin/sh\nif x; then\n  echo 1", "open"), (".a{color:red;margin:0}.b{color:blue}", "ends"), (".a{color:red;margin:0}.b{col", "open")],
)
def test_endings(text, verdict):
    assert ending(text.rstrip()) == verdict


def test_kinds():
    assert [kind_of(t) for t in (CODE, PY, PROSE, "", "  (0x1, 2),\n")] == ["code", "python", "prose", "prose", "tuples"]


def test_bodies(spark):
    cases = [("a b \n", "a b"), ("a b...", "a b"), ("a [cut]", "a"), ("a\n<connection closed>", "a"), ("a�", "a"), ("a …\r\n", "a"), (" \n", ""), ("x" + " " * 5000, "x"), ("(truncated by peer)", ""), ("a [b]", "a [b]"), ("y" * 5000 + "[truncated]", "y" * 5000), ("y" * 300 + "[connection closed by the peer]" + " " * 190, "y" * 300), ("z" + " \n" * 20_000 + "(cut)", "z")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "text string")
    assert [r[0] for r in got.select(body_of(got.text)).collect()] == [b for _, b in cases]


S = "doc_id bigint, text string, source string, body string, word string"


def test_prefix_and_words(spark):
    whole = [CODE + f"int next{i}(int a) {{\n    return resolve(a);\n}}\n" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(whole)]
    cut = {100: whole[3][:60], 101: whole[3][:60] + " [cut]", 102: whole[5][: len(CODE) + 5], 103: "def other(b):\n    widget = b + 1\n    return widg", 104: PY + "def more(a):\n    return "}
    fine = {200: whole[3].rstrip(), 201: CODE, 202: None, 203: "", 204: " \n", 205: PROSE + "\nTo be continued", 206: CODE + "\nTo be continued", 207: PY + "\nTo be continued\n", 208: "tiny", 209: PROSE + "See below: more to come, To be continued", 210: PY, 211: PY}
    words = [(300 + i, PY + f"record = widget({i})\n") for i in range(12)]
    data = [*rows, *cut.items(), *((k, v) for k, v in fine.items() if k not in (205, 206, 207, 208, 209)), *words, (400, "long " * 400_000 + "end.")]
    df = spark.createDataFrame([(k, v, "s" if k else None, "clash", "clash") for k, v in data], S).repartition(4)
    df = df.unionByName(df.where("doc_id = 100"))
    got = {r.doc_id: r.evidence for r in truncated(df).collect()}
    assert set(got) == set(cut)
    assert got[100] == got[101] == "prefix" and got[103] == "word" and got[104] == "blank"
    rates = {r.source: (r.n_documents, r.n_truncated) for r in truncation_rates(df).collect()}
    assert rates["s"] == (df.count() - 1, 6) and rates[None] == (1, 0)


def test_phrases(spark):
    rows = [(i, PROSE * (i + 1) + "\nTo be continued") for i in range(4)] + [(9, PROSE + "\nNever seen before")]
    got = {r.doc_id for r in truncated(spark.createDataFrame([(*r, "s", "", "") for r in rows], S)).collect()}
    assert got == {9}


def test_every_range_edge(spark):
    """Copies of one text over many ranges, and its longer copy in the last."""
    base = "word and word again and so on without an end of " * 3
    rows = [(i, base) for i in range(50)] + [(99, base + "sentence here.\nMore.")]
    df = spark.createDataFrame([(*r, "s", "", "") for r in rows], S).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r.doc_id for r in judged(df).where("evidence = 'prefix'").collect()} == set(range(50))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert judged(spark.createDataFrame([], S)).count() == 0


def test_more_kinds():
    assert kind_of("# settings of the run\na:\n  b: 1\n  c: two words here.\n  not") == "yaml"
    assert [ending(t) for t in ("# c.\na:\n  b: 1\n  not", "const t = [\n  [0x1, 2],\n  [0x", "<!-- x -->\n<p>Whole.</p>\n<div clas")] == ["open"] * 3


def test_any_longer_text_counts(spark):
    """Between a cut text and the whole one stand another cut and a copy that goes on at a line break."""
    a = "import x\n\ndef f(a):\n    y = call(a)"
    rows = [a, a + ".va", a + "\n    return y\n", a + ".value\n    return y\n"]
    deep = ["note " * 6 + "(a)" * k for k in (1, 2, 3)] + ["note " * 6 + "(a)" * 3 + ".\nMore."]
    data = [(i, t, "s", "", "") for i, t in enumerate([*rows, *deep])]
    df = spark.createDataFrame(data + [(100 + i, a, "s", "", "") for i in range(30)], S)
    for n in ("1", "7", "37"):  # one range, and so many that the texts stand in different ones
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.doc_id for r in judged(df).where("evidence = 'prefix'").collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {0, 1, 4, 5, 6, *range(100, 130)}


def test_kind_is_told_from_the_whole_text():
    import time

    licence = "/*\n" + " * Copies of this work must keep this notice\n" * 200 + " */\n"
    assert kind_of(licence + CODE) == "code" and ending(licence + "int walk() {\n    foo(a);") == "open" and ending((licence + CODE).rstrip()) == "ends"
    notes = "# Copies of this work must keep this notice\n" * 200
    assert kind_of(notes + PY) == "python" and ending(notes + PY + "walk(a") == "open"
    assert kind_of(PY * 100 + 'q = """\nselect 1;\n"""\n') == "python"
    # a minified line is not code because of where a head of it would end
    assert kind_of("a({b:1});" * 443 + "var xy={" + "c(1);d(2)," * 300 + "e") == "minified"
    began = time.perf_counter()
    for long in ("\n" * 300_000, " " * 300_000 + "x", ".a{" + "b" * 300_000, ".a{" + "b:" * 150_000, "x\n" * 150_000, "(" * 300_000):
        kind_of(long)
    assert time.perf_counter() - began < 10


def test_near_copies_share_no_phrase(spark):
    """Copies of one notice with another year or owner, cut in one line; a word cut in two; a phrase of few among many."""
    def evidence(texts):
        return {r.doc_id: r.evidence for r in truncated(spark.createDataFrame([(i, t, "s", "", "") for i, t in enumerate(texts)], S)).collect()}

    years = [f"Notice of {2000 + i}\n{PROSE * 4}Nothing in this paper lets them" for i in range(4)]
    owners = [f"Notice of {'owner' * (i + 1)}\n{PROSE * 4}Nothing in this paper lets them" for i in range(4)]
    assert evidence(years) == evidence(owners) == dict.fromkeys(range(4), "line")
    lines = [f"{PROSE * (i + 1)}\nThey resolve the reco" for i in range(4)] + [f"The record {i} is kept.\n" for i in range(30)]
    assert evidence(lines) == dict.fromkeys(range(4), "word")
    phrase = [f"{PROSE * (i + 1)}\nand so on" for i in range(4)] + [f"The one {i} is kept.\n" for i in range(40)] + ["It stands on the one.\n"]
    assert evidence(phrase) == {}
    blanks = [f"{PROSE * (i + 1)}\nNothing in this paper lets " for i in range(4)]
    assert evidence(blanks) == dict.fromkeys(range(4), "blank")
    phrases = [f"{PROSE * (i + 1)}\nTo be continued" for i in range(3)]
    whole = [f"Text {i} is whole." for i in range(20_000)]
    assert evidence(phrases + whole[:10]) == {} and set(evidence(phrases + whole)) == {0, 1, 2}


def test_cut_in_the_last_line(spark):
    """A longer copy that goes on to the end of the line alone; edits of a last line are none."""
    line = "import widget\nx = foo(a)"
    cut = [line, "var walk=function(a){return resolve(a)}", PROSE + "The record is kept (here)"]
    longer = [line + ".bar()", cut[1] + "(7);", cut[2] + " in the widget."]
    kept = [PROSE + "The widget is kept.", PY + "walk = widget(1)\n", PY + "walk = widget(1)", PROSE + "It is kept (here)\n"]
    edited = [kept[0] + " So is the record.", PY + "walk = widget(1) + 2\n", PROSE + "It is kept (here) now.\n"]
    data = [(k + i, t, "s", "", "") for k, rows in ((0, cut), (100, longer), (200, kept), (300, edited)) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data + [(400 + i, line, "s", "", "") for i in range(30)], S)
    for n in ("1", "7", "41"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.doc_id for r in judged(df).where("evidence = 'prefix'").collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {0, 1, 2, *range(400, 430)}


def test_lengths_around_the_fixed_prefixes(spark):
    """Brute force over texts of many lengths, copies and documents without an id among them."""
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(1100))
    texts = {base[:n].rstrip() for n in (19, 20, 21, 31, 32, 63, 64, 65, 127, 128, 255, 256, 257, 300, 511, 512, 513, 767, 768, 1023, 1024, 1025, 1100)}
    texts |= {base[:n].rstrip() + "ccc" for n in (20, 40, 200, 256, 300, 512, 800)} | {base[:n].rstrip() + "\nccc" for n in (30, 64, 256, 768)}
    texts = sorted(texts)
    data = [(i if i % 5 else None, t, "s", "", "") for i, t in enumerate(texts)] + [(1000 + i, t, "s", "", "") for i, t in enumerate(texts[:9])]
    df = spark.createDataFrame(data, S).repartition(5)
    from voxtree.llm.truncation import _SCHEMA, _bodies, _facts, _goes_on, _identity, carried_on
    from pyspark.sql import functions as F

    facts = _bodies(df).select("doc_id", "mark", "body", F.lit(False).alias("blank"), F.lit(False).alias("broken")).mapInArrow(_facts, _SCHEMA)
    got = {(r.hi, r.lo): r.how for r in carried_on(df, facts).collect()}
    bodies = [t for t in texts if len(t) >= 20]
    want = {_identity(a): max((_goes_on(b, len(a), b.rfind("\n")) for b in bodies if b != a and b.startswith(a)), default=0) for a in bodies}
    assert got == {k: how for k, how in want.items() if how} and len(got) > 15


def test_last_words_of_any_script_and_length(spark):
    long = "pqrstuvw" * 20
    texts = [f"{PROSE}The {w} number {i} is here.\n" for w in ("СТРОКА", "строка", long) for i in range(6)]
    cut = [PROSE + "Do not walk, " + w for w in ("(СТРО", "(стро", "(" + long[:100])]
    got = {r.doc_id: r.evidence for r in truncated(spark.createDataFrame([(i, t, "s", "", "") for i, t in enumerate(cut + texts)], S)).collect()}
    assert got == dict.fromkeys(range(3), "word")
