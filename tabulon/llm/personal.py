"""Personal data: fixed patterns, and a linear-chain conditional random field
over word shapes that adds spans the patterns do not reach.

The patterns (e-mail, IP address, card and phone number) are matched over
whole texts, leftmost and non-overlapping per kind; a match that fails its
check (parts at most 255, Luhn, number of digits) is dropped.  The field
labels words B-/I- by kind or O from the shape, digit groups, ends and marks
of each word and from two words to either side; it is trained in NumPy (exact
forward-backward gradients, all lines in step) on a small labelled table that
``labelled_lines`` fills from templates, and decoded by Viterbi for many
stretches at a time.  A stretch is a run of whole words of one line around
those that hold a digit, ``@`` or ``(at)``, with at least ``CONTEXT`` words on
either side; no other word can be part of a span.  What the field finds
becomes a span if it passes the check of its kind, is written as such data is
(an address with ``@`` or ``(at)``, a phone number in groups, a secret of 12
or more letters and digits) and touches no other span.  ``secret`` (passwords,
tokens, keys) is a kind of the field alone.

Defined results: null text is empty and has no span; repeated rows stay; null
ids are fine; positions are code points, end exclusive; an empty table gives
an empty result; other columns play no part (``redact`` keeps them).
"""

from __future__ import annotations

import functools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive and at the start of a run of digits: the same matches in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"\S+")
TELLING = re.compile(r"[0-9@]|\(at\)|\[at\]")
CONTEXT = 4
FEATURES = 2**16
#: Words scored at once within a long stretch.
SLICE = 20_000

TEMPLATES = """
call me at {phone} tomorrow morning
my number is {phone} or write to me
phone: {phone} and ask for the office
tel. {phone} mornings only
Please dial {phone} for help
reach us under {phone} today
fax {phone} the signed form
mobile {phone} is best
you can text {phone} any time
her telephone number, {phone}, was on the card
contact {email} or {phone}
write to {email} with questions
mail {email} for offers
send it to {email} please
the address is {email} as before
reply to {email} soon
e-mail: {email} (office)
questions go to {email} before noon
his mail {email} bounced
ask {email} about it
{email} wrote this in {year}
by {email}, {date}
you may find {email} there
host {ip} did not answer
connect from {ip} to the server
login from {ip} was refused
card {card} expires soon
credit card number {card} on file
charge {card} please
the token = "{secret}" was revoked
token: {secret} for the build
password={secret} in the file
api_key={secret} was found
secret = '{secret}' must not be shared
export API_TOKEN={secret} before use
my password is {secret} as of now
access key {secret} expired
token {secret} is not valid
the secret {secret} was rotated
passwd: {secret}
KEY: {secret}
order {small} was shipped on {date} at {time}
version {version} of the tool fixes {small} bugs
the invoice no. {code} is due
chapter {small} page {small} of the second edition
between {year} and {year} sales rose by {price} percent
commit {hash} broke the build
merged {hash} into main
the checksum {hash} did not match
image {hash} was pulled in {small} seconds
see {hash} for the change of {date}
reverted by {hash} on {date}
sha1 {hash} of the file
object {hash} is not in the index
digest: {hash}
revision {hash} has {small} files
row {small} holds {hash} as its name
id={hash} in the list
version={version} size={small} at={date}
size: {small} rows: {long}
licensed under the Apache License, Version {version}
room {small} on floor {small} from {time} to {time}
part numbers {parts} and {parts} are sold out
scores were {score}, {score} and {score} at the end
isbn {isbn} is out of print
she lives at {small} main street since {year}
the code {long} opens the door
{small} of {small} samples failed in {year}
see section {section} of the manual
it weighs {small} grams and costs {price}
call it {date} or {year} as you like
the number {long} is a prime
contact us at the office (at) noon on {date}
serial {parts} was replaced on {date}
he ran {price} km in {time} hours
id {long} and row {small} of table {section}
{hash}
{long} {small} {price}
"""
MARK = re.compile(r"\[(email|ip|card|phone|secret)\|((?:[^\]\[]|\[at\])*)\]")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


class _Filler:
    """Made-up values by kind, the same for the same seed."""

    NAMES = ("john.smith", "anna", "bob_lee", "m.rossi", "carla77", "sales", "info", "j.doe+list", "x.y.z", "office24")
    HOSTS = ("example.com", "mail.example.org", "shop.example.net", "example.co.uk", "a-b.example.it")
    PHONES = ("({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "{3} {3} {4}", "0{2} {4} {4}", "0{3} {8}", "0{3} {7}",
              "00{2} {2} {6}", "+{1} ({3}) {3}-{4}", "0{4} {3} {3}", "{1}-{3}-{3}-{4}", "0{2}-{3}-{4}", "0{3}/{7}")

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return str(self.rng.randint(1, 9)) + "".join(self.rng.choice("0123456789") for _ in range(n - 1))

    def hex(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789abcdef") for _ in range(n))

    def phone(self):
        return re.sub(r"\{(\d)\}", lambda m: self.digits(int(m.group(1))), self.rng.choice(self.PHONES))

    def email(self):
        at = self.rng.choice(("(at)", "[at]", "(at)", "[at]", "@"))
        return self.rng.choice(self.NAMES) + at + self.rng.choice(self.HOSTS)

    def ip(self):
        return ".".join(str(self.rng.randint(0, 255)) for _ in range(4))

    def card(self):
        body = self.digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return self.rng.choice(("", " ", "-")).join(body[i:i + 4] for i in range(0, 16, 4))

    def secret(self):
        letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
        return self.rng.choice((self.hex(18), self.hex(40), self.hex(32),
                                "sk" + "".join(self.rng.choice(letters) for _ in range(self.rng.randint(16, 40))) + "7"))

    def other(self, name: str) -> str:
        r, d = self.rng, self.digits
        return {"small": lambda: d(r.randint(1, 4)), "year": lambda: str(r.randint(1900, 2030)),
                "date": lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
                "time": lambda: f"{r.randint(1, 23)}:{r.randint(10, 59)}",
                "version": lambda: ".".join(d(1) for _ in range(r.randint(2, 3))),
                "section": lambda: ".".join(d(1) for _ in range(r.randint(2, 4))),
                "price": lambda: d(r.randint(1, 3)) + "." + d(2), "code": lambda: d(4) + "-" + d(6),
                "hash": lambda: self.hex(r.choice((7, 18, 32, 40))), "long": lambda: d(r.randint(5, 14)),
                "parts": lambda: d(2) + "-" + d(3) + "-" + d(r.randint(2, 4)), "score": lambda: d(1) + "-" + d(1),
                "isbn": lambda: "978-" + d(1) + "-" + d(2) + "-" + d(6) + "-" + d(1)}[name]()

    def fill(self, template: str) -> str:
        def value(m):
            kind = m.group(1)
            return f"[{kind}|{getattr(self, kind)()}]" if kind in KINDS else self.other(kind)

        return re.sub(r"\{(\w+)\}", value, template)


def labelled_lines(templates: str = TEMPLATES, times: int = 8, seed: int = 1) -> str:
    """The small labelled table: each template ``times`` times with made-up
    values, a span as [kind|text]; every other line starts with a capital."""
    filler = _Filler(seed)
    lines = [filler.fill(t) for t in templates.strip().split("\n") for _ in range(times)]
    return "\n".join(x[0].upper() + x[1:] if i % 2 else x for i, x in enumerate(lines))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _address(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if _address(m.group())]
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def shape(word: str) -> str:
    """Classes of characters, runs shortened to one of three lengths."""
    out, last, n = [], "", 0
    for c in word + "\n":
        k = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if k != last:
            if last:
                out.append(last if last not in "9Xx" else last + ("" if n == 1 else "+" if n < 5 else "*"))
            last, n = k, 0
        n += 1
    return "".join(out)[:40]


def _slot(*parts: str) -> int:
    return zlib.crc32("\t".join(parts).encode("utf-8", "surrogatepass")) % FEATURES


def _groups(word: str) -> str:
    """Digit runs by length (9 for longer ones), letter runs as ``a``."""
    runs = re.sub(r"[0-9]+", lambda m: str(min(9, len(m.group()))), re.sub(r"[^\W\d_]+", "a", word))
    return runs[:24]


def _name(word: str) -> str:
    runs = re.findall(r"[^\W\d_]+", word)
    return runs[-1].lower()[:20] if runs else word[:4]


class Slots(dict):
    """Feature slots of a word by itself and as a neighbour, kept per word."""

    def __missing__(self, word: str):
        if len(self) > 100_000:
            self.clear()
        bare = word.strip(".,:;!?\"'()")
        plain, groups, n = bare.lower()[:20], _groups(bare), len(_digits(word))
        # the last part of a name: the same for password=..., db_password: ... and PASSWORD ...
        key = _name(re.split(r"[=:]", bare)[0]) if "=" in bare or ":" in bare else ""
        marks = "".join(x for x in ("(at)", "[at]", "@", "=", "/", "(") if x in word)
        kind = "hex" if re.fullmatch(r"[0-9a-f]{12,}", bare) else "mixed" if len(bare) > 11 and bare.isalnum() and n else ""
        self[word] = out = tuple(_slot(*f) for f in (
            ("shape", shape(bare)), ("groups", groups), ("digits", str(min(20, n))), ("marks", marks, kind),
            ("word", plain), ("head", word[:2], str(min(5, n))), ("tail", plain[-3:]), ("namer", key or "-", str(len(bare) > 11)),
            ("left", groups), ("namer", _name(bare), "True"), ("left2", groups), ("namer2", _name(bare)),
            ("right", groups), ("rightword", plain), ("right2", groups)))
        return out


#: Of a word's slots, those it has as its own, and as a neighbour so many words off.
OWN, BESIDE = slice(0, 8), ((1, slice(8, 10)), (2, slice(10, 12)), (-1, slice(12, 14)), (-2, slice(14, 15)))


def slots(words: list[str], known: Slots) -> np.ndarray:
    own = np.array([known[w] for w in words], np.int64)
    parts = [own[:, OWN]]
    for off, which in BESIDE:
        part = np.full_like(own[:, which], _slot("edge", str(off)))
        if off > 0:
            part[off:] = own[:-off, which]
        else:
            part[:off] = own[-off:, which]
        parts.append(part)
    return np.concatenate(parts, axis=1)


def emissions(words: list[str], weights: np.ndarray, known: Slots) -> np.ndarray:
    """Label scores of each word, slice by slice with the neighbours beyond."""
    out = []
    for lo in range(0, len(words), SLICE):
        first = max(0, lo - 2)
        x = slots(words[first:lo + SLICE + 2], known)[lo - first:][:SLICE]
        total = weights[x[:, 0]]
        for f in range(1, x.shape[1]):
            total = total + weights[x[:, f]]
        out.append(total)
    return np.concatenate(out)


def labelled(line: str) -> tuple[list[str], list[int]]:
    """Words and labels of a marked line."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(line):
        text += line[at:m.start()]
        spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    text += line[at:]
    words, labels = [], []
    for m in WORD.finditer(text):
        kind = next((s for s in spans if s[1] < m.end() and m.start() < s[2]), None)
        words.append(m.group())
        labels.append(LABELS.index(("B-" if m.start() <= kind[1] else "I-") + kind[0]) if kind else 0)
    return words, labels


@functools.lru_cache(maxsize=4)
def train(examples: str | None = None, rounds: int = 120, rate: float = 0.1, decay: float = 5e-4):
    """Emission (FEATURES x labels) and transition weights, by Adam on the
    regularised conditional likelihood of all lines at once."""
    known, k = Slots(), len(LABELS)
    rows = [(slots(w, known), np.array(y)) for w, y in map(labelled, filter(None, (examples or labelled_lines()).split("\n")))]
    rows.sort(key=lambda r: -len(r[1]))  # lines of a word t or more stand first
    length = np.array([len(y) for _, y in rows])
    lines, top = len(rows), int(length.max())
    alive = [int((length > t).sum()) for t in range(top)]
    used, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    at = at.reshape(int(length.sum()), -1)
    design = np.zeros((len(at), len(used)))
    np.add.at(design, (np.arange(len(at))[:, None], at), 1)
    cell = (np.repeat(np.arange(lines), length), np.concatenate([np.arange(n) for n in length]))
    gold = np.concatenate([y for _, y in rows])
    truth = np.zeros((len(gold), k))
    truth[np.arange(len(gold)), gold] = 1
    steps = np.zeros((k + 1, k))
    for _, y in rows:
        np.add.at(steps, (np.concatenate([[k], y[:-1]]), y), 1)
    params = [np.zeros((len(used), k)), np.zeros((k + 1, k))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def log_sum(z, axis):
        m = z.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(z - m).sum(axis=axis))

    for step in range(1, rounds + 1):
        move = params[1]
        emit, ahead, back = (np.zeros((lines, top, k)) for _ in range(3))
        emit[cell] = design @ params[0]
        ahead[:, 0] = emit[:, 0] + move[k]
        for t in range(1, top):
            n = alive[t]
            ahead[:n, t] = emit[:n, t] + log_sum(ahead[:n, t - 1, :, None] + move[None, :k], 1)
        for t in range(top - 2, -1, -1):
            n = alive[t + 1]
            back[:n, t] = log_sum(move[None, :k] + (emit[:n, t + 1] + back[:n, t + 1])[:, None], 2)
        whole = log_sum(ahead[np.arange(lines), length - 1], 1)
        p = np.exp(ahead + back - whole[:, None, None])[cell]
        expected = np.zeros((k + 1, k))
        expected[k] = np.exp(ahead[:, 0] + back[:, 0] - whole[:, None]).sum(0)
        for t in range(1, top):
            n = alive[t]
            z = ahead[:n, t - 1, :, None] + move[None, :k] + (emit[:n, t] + back[:n, t] - whole[:n, None])[:, None]
            expected[:k] += np.exp(z).sum(0)
        grads = [design.T @ (p - truth) + decay * lines * params[0], expected - steps + decay * lines * move]
        for w, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    move = params[1].copy()
    for j, name in enumerate(LABELS):  # I- only after B- or I- of its kind
        if name.startswith("I-"):
            move[[i for i in range(k + 1) if i == k or LABELS[i][2:] != name[2:]], j] = -1e9
    weights = np.zeros((FEATURES, k), np.float32)
    weights[used] = params[0]
    return weights, move


def viterbi(emits: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best labels of every stretch, all stretches of a batch in step."""
    if not emits:
        return []
    k = move.shape[1]
    order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
    length = np.array([len(emits[i]) for i in order])
    top = int(length[0])
    best = np.stack([emits[i][0] for i in order]) + move[k]
    ends, paths = np.zeros((len(order), k)), [np.zeros((0, k), np.int8)]
    for t in range(top):
        if t:
            n = int((length > t).sum())
            z = best[:n, :, None] + move[None, :k]
            paths.append(z.argmax(axis=1).astype(np.int8))  # of the stretches that reach t only
            best = z.max(axis=1) + np.stack([emits[i][t] for i in order[:n]])
        done = np.flatnonzero(length == t + 1)
        ends[done] = best[done]
    out: list = [None] * len(order)
    for row, i in enumerate(order):
        y = [int(ends[row].argmax())]
        for t in range(length[row] - 1, 0, -1):
            y.append(int(paths[t][row, y[-1]]))
        out[i] = np.array(y[::-1])
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Positions of whole words around words with a digit, ``@`` or ``(at)``,
    line by line."""
    out, last, hi = [], 0, -1
    for m in TELLING.finditer(text):
        if m.start() < last:
            continue
        lo = max(text.rfind("\n", last, m.start()) + 1, last)
        if hi < m.end():
            hi = text.find("\n", m.end())
            hi = len(text) if hi < 0 else hi
        run, quiet = [], 0
        for w in WORD.finditer(text, lo, hi):
            run.append(w.span())
            if w.end() <= m.start():
                if len(run) > 64:
                    run = run[-CONTEXT:]
                continue
            if not quiet and len(run) > CONTEXT and run[-1][0] <= m.start():
                run = run[-CONTEXT - 1:]
            quiet = 0 if TELLING.search(w.group()) else quiet + 1
            if quiet >= 2 * CONTEXT:
                break
        last = run[-1][1]
        out.append(run)
    return out


def _checked(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+(@|\(at\)|\[at\])[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) is not None
    if kind == "ip":
        return IP.fullmatch(text) is not None and _address(text)
    if kind == "card":
        return re.fullmatch(r"[0-9 -]+", text) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return re.fullmatch(r"[A-Za-z0-9+/_-]{12,}", text) is not None and len(set(text)) > 5 \
            and digits != "" and re.search(r"[A-Za-z]", text) is not None
    return re.fullmatch(r"\+?[0-9()][0-9() ./-]*[0-9]", text) is not None and 9 <= len(digits) <= 15 \
        and re.search(r"[0-9)][ ./-][0-9]", text) is not None


def all_spans(texts: list[str], model) -> list[list[tuple[int, int, int, bool]]]:
    """(kind index, start, end, base) for each text, by kind, then start."""
    emission, move = model
    known, runs, owner, emits = Slots(), [], [], []
    found = [base_spans(t) for t in texts]
    for i, text in enumerate(texts):
        for run in stretches(text):
            runs.append(run)
            owner.append(i)
            emits.append(emissions([text[a:b] for a, b in run], emission, known))
    out = [[(*s, True) for s in spans] for spans in found]
    for i, run, y in zip(owner, runs, viterbi(emits, move)):
        text, t = texts[i], 0
        while t < len(y):
            label = LABELS[y[t]]
            u = t + 1
            if label.startswith("B-"):
                while u < len(y) and LABELS[y[u]] == "I-" + label[2:]:
                    u += 1
                a, b = run[t][0], run[u - 1][1]
                while a < b and not (text[a].isascii() and text[a].isalnum() or text[a] in "+("):
                    a += 1
                while a < b and not (text[b - 1].isascii() and text[b - 1].isalnum()):
                    b -= 1
                while text[a:a + 1] == "(" and text.count("(", a, b) > text.count(")", a, b):
                    a += 1  # a bracket around the value, not of it
                if label[2:] in ("secret", "email"):  # the value behind a name
                    a += max(text[a:b].rfind(c) for c in "=:\"'") + 1
                if _checked(label[2:], text[a:b]) and all(b <= s[1] or s[2] <= a for s in out[i]):
                    out[i].append((KINDS.index(label[2:]), a, b, False))
            t = u
    return [sorted(s) for s in out]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def _pieces(batch: pa.RecordBatch, at: int, size: int = 1000):
    for lo in range(0, batch.num_rows, size):
        part = batch.slice(lo, size)
        yield part, ["" if t is None else t for t in part.column(at).to_pylist()]


def find(docs: DataFrame, examples: str | None = None) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    model = train(examples)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part, texts in _pieces(batch, 1):
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in s]
                         for s in all_spans(texts, model)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, examples: str | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as in
    ``<email>`` (of overlapping spans by the first one's); null stays null,
    and n_chars, if there, follows the text."""
    prepare(docs.sparkSession)
    model = train(examples)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            for part, texts in _pieces(batch, at):
                out = []
                for text, spans in zip(texts, all_spans(texts, model)):
                    pieces, end = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
                        if a >= end:
                            pieces += [text[end:a], f"<{KINDS[k]}>"]
                        end = max(end, b)
                    out.append("".join(pieces) + text[end:])
                new = pa.array(out, batch.schema.field(at).type, mask=part.column(at).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)],
                                                 names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out
