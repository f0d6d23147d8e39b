"""The field on sentences and values it was not trained on, its gradients'
decoding against all label sequences, and whole words and stretches."""

import itertools
import re

import numpy as np

from tabulon.llm import personal as P

HELD_OUT = """
ring {phone} if the door is shut
Her cell: {phone}
for bookings use {phone} between ten and noon
Tel {phone} / reception
please forward this to {email} today
Author {email} wrote the patch
any bugs? tell {email}
send the report to {email}, thanks
auth token {secret} leaked in the log
db_password={secret}
the new password = "{secret}"
API_KEY: {secret}
"""
CLEAN = """
built {hash} on {date} in {small} seconds
the file {long}.txt has {small} lines
page {small}, line {small}, year {year}
release {version} came out on {date}
table {section} lists {parts} and {price}
book {isbn} costs {price} euros
md5 {hash} of the archive
"""


def spans(line):
    """Text and marked spans of a line."""
    text, out, at = "", [], 0
    for m in P.MARK.finditer(line):
        text += line[at:m.start()]
        out.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    return text + line[at:], out


def test_recall_on_held_out_lines():
    lines = [spans(x) for x in P.labelled_lines(HELD_OUT, 25, seed=99).split("\n")]
    found = P.all_spans([t for t, _ in lines], P.train())
    hit, of = {}, {}
    for (_, gold), got in zip(lines, found):
        got = {(P.KINDS[k], a, b) for k, a, b, _ in got}
        for g in gold:
            of[g[0]] = of.get(g[0], 0) + 1
            hit[g[0]] = hit.get(g[0], 0) + (g in got)
    assert all(hit[k] >= 0.8 * of[k] for k in of), (hit, of)


def test_clean_lines_are_left_alone():
    lines = P.labelled_lines(CLEAN, 40, seed=98).split("\n")
    added = [(t, s) for t, f in zip(lines, P.all_spans(lines, P.train())) for s in f if not s[3]]
    assert len(added) <= 0.02 * len(lines), added[:20]


def test_values_written_in_other_ways():
    for value in ("917-555-0142", "212.555.0187", "303-555-0101", "0151 23456789"):
        (got,) = P.all_spans([f"her number is {value} at work"], P.train())
        assert [s[0] for s in got] == [3], value
    for value in ("peter.pan(at)example.org", "k.long[at]mail.example.de", "support(at)example.info"):
        (got,) = P.all_spans([f"write to {value} about it"], P.train())
        assert [s[0] for s in got] == [0], value


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(3)
    emits, move = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 4, 3)], rng.normal(size=(4, 3))
    for e, y in zip(emits, P.viterbi(emits, move)):
        def total(seq):
            return move[3, seq[0]] + sum(e[i, s] for i, s in enumerate(seq)) + sum(move[a, b] for a, b in zip(seq, seq[1:]))
        assert tuple(y) == max(itertools.product(range(3), repeat=len(e)), key=total)


def test_words_and_stretches_are_whole():
    text = "x " * 3000 + "y" * 5000 + "7" + "z" * 5000 + " 1" * 3000 + "\n5"
    words = {m.span() for m in re.finditer(r"\S+", text)}
    runs = P.stretches(text)
    assert all(w in words for run in runs for w in run)
    flat = [w for run in runs for w in run]
    assert len(flat) == len(set(flat)) and {w for w in words if re.search("[0-9@]", text[slice(*w)])} <= set(flat)
    # a number far into a run of numbers is still one
    (got,) = P.all_spans(["5 " * 1000 + "please call 555-201-7788 soon"], P.train())
    assert [s[:1] + (s[3],) for s in got if s[0] == 3] == [(3, False)]
    # slices see their neighbours
    words = text.split()[-2500:]
    weights, known = P.train()[0], P.Slots()
    whole, size = P.emissions(words, weights, known), P.SLICE
    try:
        P.SLICE = 7
        assert np.allclose(P.emissions(words, weights, known), whole)
    finally:
        P.SLICE = size


#: Lines that were looked at neither while the templates nor the features were chosen.
UNSEEN = """
dial {phone} after six
cell phone ({phone}) of the driver
you will get an answer from {email} within a week
cc {email} on this
login_token={secret}
he typed the password {secret} twice
"""


def test_recall_on_unseen_lines():
    lines = [spans(x) for x in P.labelled_lines(UNSEEN, 25, seed=7).split("\n")]
    found = P.all_spans([t for t, _ in lines], P.train())
    hit = [(g[0], g in {(P.KINDS[k], a, b) for k, a, b, _ in got}) for (_, gold), got in zip(lines, found) for g in gold]
    recall = {k: sum(h for j, h in hit if j == k) / sum(j == k for j, _ in hit) for k in ("phone", "email", "secret")}
    print(recall)
    assert all(r >= 0.8 for r in recall.values()), recall
