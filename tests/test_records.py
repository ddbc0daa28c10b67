import csv
import io
import random

import pyarrow as pa
import pytest

from plumbline.operators import records as R

GOOD = "AB12,1.5,2,3,-4,.5,0.1,0.2,0.3,accepted,10,roof"


def reasons(lines):
    cols, why = R.parse_lines(pa.array(lines, pa.string()), R.STATION_LINE)
    return why, cols


CASES = {
    GOOD: None, GOOD + "\r": None, GOOD.replace("1.5", "NaN"): None, GOOD.replace("1.5", ""): None, GOOD.replace("1.5", " +1.5e3 "): None, GOOD.replace("1.5", '"1.5"'): None,
    GOOD.replace("roof", '"two, ""quoted"" words\nand lines"'): None, GOOD.replace("roof", ""): None,
    GOOD.replace("roof", 'a "b" c'): R.BROKEN, GOOD.replace("roof", '"open'): R.BROKEN, GOOD.replace("roof", '"x"y'): R.BROKEN, GOOD.replace("AB12", '"AB12'): R.BROKEN, GOOD.replace("roof", 'a""b'): R.BROKEN,
    "": R.COUNT, "a,b": R.COUNT, GOOD + ",more": R.COUNT, None: R.COUNT, '"a,b': R.BROKEN,
    GOOD.replace("1.5", "nan"): R.VALUE, GOOD.replace("1.5", "inf"): R.VALUE, GOOD.replace("1.5", "1e999"): R.VALUE, GOOD.replace("1.5", "1_0"): R.VALUE, GOOD.replace("1.5", "0x1"): R.VALUE,
    GOOD.replace("1.5", "١.5"): R.VALUE, GOOD.replace("1.5", "1.5 x"): R.VALUE, GOOD.replace("0.1", "-0.1"): R.VALUE, GOOD.replace("0.1", "-0"): None, GOOD.replace("1.5", "."): R.VALUE, GOOD.replace("1.5", "1e"): R.VALUE,
    GOOD.replace("1.5", "1.5\n"): R.VALUE, GOOD.replace("10", "ten"): R.VALUE,
}


def test_cases_alone_and_in_a_block():
    lines = list(CASES)
    for line, want in CASES.items():
        assert reasons([line])[0] == [want], line
    mixed = [GOOD] * 700 + lines + [GOOD] * 900
    assert reasons(mixed)[0] == [None] * 700 + list(CASES.values()) + [None] * 900


def test_random_damage_equals_strict_parser():
    rng, alphabet = random.Random(4), ',"\r\n 1.-+eN'
    lines = []
    for _ in range(3000):
        text = GOOD
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(alphabet) + text[i + rng.choice([0, 1]) :]
        lines.append(text)
    why, cols = reasons(lines)
    for i, line in enumerate(lines):
        r, values = R.diagnose(line, R.STATION_LINE)
        assert why[i] == r
        assert [c[i].as_py() for c in cols] == (values if r is None else [None] * 12)


def test_round_trip_of_the_csv_module():
    rng = random.Random(1)
    rows = [["".join(rng.choice('ab,"\n é') for _ in range(6)), *["1.5"] * 8, "q", "2", "".join(rng.choice('x," ') for _ in range(5))] for _ in range(400)]
    lines = []
    for row in rows:
        f = io.StringIO()
        csv.writer(f, lineterminator="").writerow(row)
        lines.append(f.getvalue())
    why, cols = reasons(lines)
    assert set(why) == {None}
    assert cols[0].to_pylist() == [r[0] for r in rows] and cols[11].to_pylist() == [r[11] for r in rows]


def test_on_a_table(spark):
    rows = [(i, line, "x") for i, line in enumerate(CASES)]
    df = spark.createDataFrame(rows, "line_id long, raw_text string, reason string").repartition(3)
    parsed = R.parse_records(df)
    assert {r["line_id"]: r["reason"] for r in R.rejected(parsed).collect()} == {i: w for i, w in enumerate(CASES.values()) if w}
    assert R.loaded(parsed).count() == sum(w is None for w in CASES.values())
    assert R.parse_records(df.limit(0)).count() == 0


def test_long_record():
    line = GOOD.replace("roof", '"' + "x," * 2_000_000 + '"')
    why, cols = reasons([GOOD, line, GOOD])
    assert why == [None] * 3 and len(cols[11][1].as_py()) == 4_000_000


@pytest.mark.parametrize("text,want", [("a,b", ["a", "b"]), ('"a""b",', ['a"b', ""]), ("", [""]), ('"', None), ('a"', None), ('"a" ,b', None)])
def test_split_record(text, want):
    assert R.split_record(text) == want
