"""The pipeline's stages over a small folder of tables, each against plain
Python, with nulls, empty and long texts, repeated rows and copies."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tabulon.llm import mixing, toxicity

BODY = " ".join(f"word{i} of text {i * 7}" for i in range(120))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"{i} " + " ".join(f"t{(i * 31 + j * 7) % 997}" for j in range(30)) + (" zquaddle fnorkel zquaddle" if i % 3 == 0 else ""),
             "en", f"s{i % 4}", 10) for i in range(240)]
    rows += [(1000 + i, BODY + (" end" if i % 2 else ""), "fr", "hot", 5) for i in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "x " * 20_000, "de", "s2", 1),
             (2003, "mail a@b.example.com now " + BODY[:50], "de", "s3", 3), (2003, "mail a@b.example.com now " + BODY[:50], "de", "s3", 3)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(1000 + i, 0) for i in range(40)],
                          "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = step(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            bad = {(r.doc_id, r.text) for r in toxicity.classify(docs, labels).where("predicted = 1").join(docs, "doc_id").collect()}
            assert Counter(after) == Counter(r for r in before if (r[0], r[1]) not in bad)
            rude = [r for r in before if r[1] and "zquaddle" in r[1]]
            gone = Counter(before) - Counter(after)
            assert sum(r in gone for r in rude) > 0.8 * len(rude) and sum(r not in rude for r in gone) <= 0.1 * len(before)
        elif name == "near_duplicates":
            sets, kept = {r: shingles(r[1]) for r in before}, Counter(after)
            groups = []
            for r in sorted(set(before), key=lambda r: (r[0], r[1] or "")):
                near = [g for g in groups if any(10 * len(sets[r] & sets[x]) >= 8 * len(sets[r] | sets[x]) and sets[r] for x in g)]
                groups = [g for g in groups if g not in near] + [[r, *(x for g in near for x in g)]]
            # one document of each group; a repeated row of it stays as well
            assert all(sum(kept[r] > 0 for r in g) == 1 for g in groups)
            assert all(kept[min(g, key=lambda r: r[0])] for g in groups)
        elif name == "pii":
            mails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            assert len(after) == len(before)
            assert Counter((r[0], mails.sub("<email>", r[1] or "")) for r in before) == Counter((r[0], r[1] or "") for r in after)
        elif name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2 * max(Counter(before).values())
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
            target = {r.source: r.target for r in mixing.mix(docs).collect()}
            assert sum(target.values()) == pytest.approx(1.5 * sum(map(size, before)))
            for source in target:  # no closer than half a document can be asked of a source that one document fills
                taken = sum(size(r) for r in after if r[3] == source)
                assert abs(taken - target[source]) <= max(size(r) for r in before if r[3] == source) / 2 + 1
        else:
            assert len(after) == len(before) and all(r.round_trip for r in out.collect())
        docs = spark.createDataFrame(after, out.schema) if name != "tokens" else out


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
