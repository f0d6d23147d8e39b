"""Quoted fields over several lines, against a sequential reader in Python."""

import random

from pyspark.sql import functions as F

from tabulon.operators import tablize as T


def fields_open(line: str, d: str) -> bool:
    """A line read from outside: does its last field open and not close?"""
    while True:
        if line.startswith('"'):
            at, closed = 1, None
            while at < len(line):
                if line[at] == '"' and line[at + 1:at + 2] == '"':
                    at += 2
                    continue
                if line[at] == '"':
                    closed = at
                    break
                at += 1
            if closed is None:
                return True
            if closed + 1 == len(line):
                return False
            if line[closed + 1] == d:
                line = line[closed + 2:]
                continue
        if d not in line:
            return False
        line = line.split(d, 1)[1]


def fold(lines: list[str], d: str) -> list[str]:
    """Records, one opening at a time."""
    out, i = [], 0
    while i < len(lines):
        last, line = i, lines[i]
        opened = fields_open(line, d)
        while opened:
            j, how = last + 1, "bad"
            while j < len(lines):
                at = lines[j].replace('""', "..").find('"')
                if at >= 0:
                    rest = lines[j][at + 1:]
                    how = "close" if rest == "" or rest[0] == d else "bad"
                    break
                j += 1
            if j == len(lines) or how == "bad":
                break
            last, opened = j, rest != "" and fields_open(rest[1:], d)
        out.append("\n".join(lines[i:last + 1]))
        i = last + 1
    return out


def test_records_equal_a_sequential_reader(spark):
    rng = random.Random(5)
    texts = [[("".join(rng.choice(['"', '""', ",", "a", '",', ',"']) for _ in range(rng.randint(0, 6))))
              for _ in range(rng.randint(1, 14))] for _ in range(150)]
    texts += [[], ['"'], ['a,"b', "", 'c",d'], ['"' + '""' * 400, 'x"'], ["plain"] * 40]
    rows = [(f"f{i}", n, line, ",") for i, lines in enumerate(texts) for n, line in enumerate(lines)]
    lns = spark.createDataFrame(rows, "file_id string, line_no long, line string, delim string")
    # few lines a partition, so that files span several
    got: dict = {}
    for r in T.fold_quoted(lns, ["file_id"], 60).orderBy("file_id", "line_no").collect():
        got.setdefault(r["file_id"], []).append(r["line"])
    for i, lines in enumerate(texts):
        assert got.get(f"f{i}", []) == fold(lines, ","), lines


def test_a_stray_quote_swallows_nothing(spark):
    body = [f"{i};name {i};{i * 2}" for i in range(60)]
    body[7] = '7;"stray;14'
    body[40] = '40;also "stray;80'
    files = spark.createDataFrame([("a", "\n".join(["id;name;size"] + body))], "file_id string, text string")
    cells = T.tablize_delimited(files)["cells"]
    assert cells.select("row").distinct().count() == 60
    assert cells.filter((F.col("row") == 7) & (F.col("col") == 1)).first()["value"] == '"stray'


def test_many_lines_in_one_field(spark):
    field = '"' + "\n".join(f"line {i}, with ""quotes""" for i in range(3000)) + '"'
    text = "id,note,n\n" + "\n".join(f"{i},{field if i == 11 else 'short'},{i}" for i in range(50))
    files = spark.createDataFrame([("a", text)], "file_id string, text string")
    cells = T.tablize_delimited(files)["cells"]
    value = cells.filter((F.col("col_name") == "note") & (F.col("row") == 11)).first()["value"]
    assert value == field[1:-1] and cells.count() == 150
