import re

from voxtree.operators.swc_lines import LENGTH_UNIT, parse_swc_lines

LINES = "neuron_id bigint, line_no int, raw_line string"
WIDTH = "neuron_id bigint, n_cols int, kind string, value string, reason string"


def judge(line, cols):
    """The rules, character by character."""
    text, i, fields = line or "", 0, []
    if not text.strip(" \t\r\n") or text.lstrip(" \t\r\n").startswith(("#", "id")):
        return None
    while i < len(text):
        if text[i] in " \t\r\n":
            i += 1
        elif text[i] == "#":
            break
        elif text[i] == '"':
            j = text.find('"', i + 1)
            if j < 0 or (j + 1 < len(text) and text[j + 1] not in " \t\r\n#"):
                return "quoting"
            fields.append(text[i + 1 : j])
            i = j + 1
        else:
            j = i
            while j < len(text) and text[j] not in ' \t\r\n#"':
                j += 1
            if j < len(text) and text[j] == '"':
                return "quoting"
            fields.append(text[i:j])
            i = j
    if len(fields) != cols:
        return "columns"

    def whole(s):
        return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) and -(2**31) <= int(s) < 2**31 else None

    def real(s):
        m = re.fullmatch(rf"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[ \t\r\n]*(?:{LENGTH_UNIT})?", s, re.IGNORECASE)
        return float(m[1]) if m and abs(float(m[1])) < float("inf") else None

    n, t, p = whole(fields[0]), whole(fields[1]), whole(fields[6])
    x = [real(f) for f in fields[2:6]]
    ok = n is not None and n >= 1 and t is not None and t >= 0 and p is not None and (p >= 1 or p == -1) and None not in x and x[3] > 0
    return None if ok else "value"


CASES = [
    "1 2 3.0 4 5. .5 -1", "1\t2\t3\t4\t5\t0.5\t-1\r\n", '"1" "2" "3 um" "4 µm" "5nm" "6 MM" "1"', '"1 " 2 3 4 5 6 1', "1 2 3 4 5 6 0", "0 2 3 4 5 6 1", "1 -1 3 4 5 6 1",
    "1 2 3 4 5 0 1", "1 2 3 4 5 -6 1", "1 2 3,0 4 5 6 1", "1 2 NaN 4 5 6 1", "1 2 1e999 4 5 6 1", "1 2 3e2 4 5 6 1", "2147483648 2 3 4 5 6 1", "2147483647 2 3 4 5 6 1", "+1 2 3 4 5 6 1",
    "1.0 2 3 4 5 6 1", "1 2 3 4 5 6", "1 2 3 4 5 6 1 8", "1,2,3,4,5,6,1", '1 2 3 4 5 6 "1', '1 2 3 4 5" 6 1', '"1"2 3 4 5 6 1', '1 2 3 4 5 6 1 # "odd', '1 2 3 4 5 6 "1"# ok', '"#1" 2 3 4 5 6 1',
    "", "   \t", "# c", "  # c", "id type", " id,x", "ID x y z r p q", None, "1 2 3 4 5 6 1 " + "x" * 100_000, '"' * 99_999, "1 2 3 4 5 6kg 1", "1 2 3_0 4 5 6 1", "1 2 3 4 5 O.75 1", "١ 2 3 4 5 6 1", "1 2 3 4 5 6 1", "99999999999999999999999999999999999999999999 2 3 4 5 6 1",
]


def test_against_rules(spark):
    rows = [(n, i, line) for n in (1, 2, 3) for i, line in enumerate(CASES)]
    lines = spark.createDataFrame(rows, LINES)
    neurons = spark.createDataFrame([(1, 7, "k", "v", "r"), (2, 12, None, None, None), (2, None, "", "", ""), (None, 7, "", "", "")], WIDTH)
    parsed = parse_swc_lines(lines, neurons)
    found = {(r.neuron_id, r.line_no): r.reason for r in parsed.rejected().collect()}
    want = {(n, i): r for n, cols in ((1, 7), (2, 12), (3, 7)) for i, line in enumerate(CASES) if (r := judge(line, cols))}
    assert found == want
    good = {(r.neuron_id, r.line_no): r for r in parsed.valid().collect()}
    rows_ = {(n, i) for n in (1, 2, 3) for i, line in enumerate(CASES) if line and line.strip(" \t\r\n") and not line.lstrip().startswith(("#", "id"))}
    assert set(good) == rows_ - set(want)
    assert good[1, 0][2:9] == (1, 2, 3.0, 4.0, 5.0, 0.5, -1)
    assert good[1, 2][4:8] == (3.0, 4.0, 5.0, 6.0)


def test_repeats_and_empty(spark):
    neurons = spark.createDataFrame([(1, 7)], "neuron_id bigint, n_cols int")
    lines = spark.createDataFrame([(1, 1, "1 2 3"), (1, 1, "1 2 3"), (1, 1, "1 2 3 4 5 6 1"), (None, None, "x y")], LINES)
    parsed = parse_swc_lines(lines, neurons)
    assert sorted((r.neuron_id or 0, r.line_no, r.reason) for r in parsed.rejected().collect()) == [(0, None, "columns"), (1, 1, "columns")]
    assert parsed.valid().count() == 1
    none = parse_swc_lines(spark.createDataFrame([], LINES), spark.createDataFrame([], "neuron_id bigint, n_cols int"))
    assert none.rejected().count() == 0 and none.valid().count() == 0
