"""Passages whose first bytes very many anchors share, against brute force."""

import random

import pytest

from tabulon.llm import suffixes


def _covered(texts: list[bytes]) -> list[bytes]:
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] = seen.get(t[i:i + 200], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_shared_headers(spark, monkeypatch, hot):
    rng = random.Random(hot)

    def words(n):
        return " ".join(rng.choice(["alpha", "béta", "gamma", "d", "epsilon", "zeta"]) + str(rng.randrange(900)) for _ in range(n))

    short, long = words(18), words(60)
    texts = [short + " " + words(rng.randrange(5, 60)) for _ in range(60)]            # header below 200 bytes: stays
    texts += [long + " " + words(rng.randrange(5, 60)) for _ in range(60)]            # header above: goes
    texts += [words(8) + long[rng.randrange(90):][:rng.randrange(190, 400)] + words(9) for _ in range(60)]
    texts += ["ab" * 700, "x" * 1_000, long + long, short, "", None, words(50)] + [texts[0]] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.union(df.where("doc_id = 70")).selectExpr("*", "1 as key", "2 as pos")
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts.append(texts[70])
    want = sorted((i if i < len(texts) - 1 else 70, b) for i, b in enumerate(_covered([(t or "").encode() for t in texts])))
    got = sorted((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect())
    assert got == want
