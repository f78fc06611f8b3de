"""Secret scans: patterns of three kinds, and a convolutional network over further candidates.

A candidate is any run of 16 or more key characters. The network sees the candidate's bytes with
those around it and a mark of which is which; it is trained on labelled findings made by rule (keys
of many formats, and look-alikes such as dates, paths, versions, numbers, long words and
identifiers), calibrated on findings kept back, and its threshold is set on others kept back: the
highest at which RECALL holds by a lower confidence bound, for secrets in candidates up to OWN bytes
and in longer ones alike. Every candidate is scored. Spans of patterns always stay; the network adds
its own where they aren't wholly inside such spans.
A candidate longer than OWN is judged by overlapping windows over all its bytes, and has the largest
of their probabilities; findings inside long runs are trained on too.

All patterns are ASCII, so they run on UTF-8 bytes; offsets are turned into code points. No step
shuffles, and texts without candidates cost one pass of byte searches.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
import warnings
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.byte_cnn import PAD, Adam, ByteNet, calibration, sigmoid
from weftgraph.llm.common import kind_of, mapped, schema_of, table, utf8

# The patterns and smallest lengths of the three kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # a maximal run of 24 or more, as the run itself takes all it can
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{16,}")
HEX_TABLE = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

BEFORE, OWN, AFTER = 24, 64, 8
LENGTH = BEFORE + OWN + AFTER
FILTERS, DIM, HIDDEN = 24, 8, 16
#: Share of secrets to be found, and how sure the threshold is to find it.
RECALL, CONFIDENCE = 0.98, 0.95
#: Below this precision on kept-back findings, train() warns.
PRECISION = 0.9
FINDINGS, PASSES, SEED = 6000, 6, 11


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the three kinds, sorted."""
    out = []
    if b"=" in data or b":" in data:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_CHARS]
    if b"h" * HEX_CHARS in data.translate(HEX_TABLE):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(out)


def candidates(data: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of every run that the network judges."""
    return [m.span() for m in CANDIDATE.finditer(data)]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of at most OWN bytes over a candidate: each byte is in one, and any OWN / 2 adjacent bytes are in one together."""
    if end - start <= OWN:
        return [(start, end)]
    return [(a, a + OWN) for a in (*range(start, end - OWN, OWN // 2), end - OWN)]


def window(data: bytes, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a candidate's piece and around it, and 1 where the piece is."""
    own = data[start:end]
    out, mark = np.full(LENGTH, PAD, np.int16), np.zeros((LENGTH, 1), np.float32)
    before, after = data[max(0, start - BEFORE) : start], data[end : end + AFTER]
    for part, at in ((before, BEFORE - len(before)), (own, BEFORE), (after, BEFORE + len(own))):
        out[at : at + len(part)] = np.frombuffer(part, "u1")
    mark[BEFORE : BEFORE + len(own)] = 1
    return out, mark


def labelled_findings(n: int, seed: int, inside: bool = False) -> list[tuple[bytes, int, int, int, int, int]]:
    """(text, start, end, label, and where the secret or its look-alike itself starts and ends) made by rule; half are secrets.

    Those inside others are parts of runs longer than OWN.
    """
    r = random.Random(seed)
    alnum, upper, hexes = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    syllables = ["the", "on", "er", "ti", "an", "re", "sch", "ung", "ción", "ado", "eau", "ment", "in", "st", "ou"]
    # syllables of many languages: seldom one of a list, mostly an onset, a vowel and a coda
    syllable = lambda: r.choice(syllables) if r.random() < 0.3 else r.choice(["", "b", "bl", "ch", "d", "f", "g", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "sp", "t", "tr", "v", "w", "z"]) + r.choice(["a", "e", "i", "o", "u", "ei", "ie", "io", "ou", "y"]) + r.choice(["", "", "n", "r", "s", "l", "t", "ch", "nt", "lich", "st", "keit", "ng"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    secret = [
        lambda: "AKIA" + some(upper, 16, 16),
        lambda: some(hexes, 32, 64),
        lambda: some(alnum, 20, 48),
        lambda: base64.b64encode(r.randbytes(r.randint(15, 40))).decode(),
        lambda: base64.urlsafe_b64encode(r.randbytes(r.randint(15, 40))).decode().rstrip("="),
        lambda: r.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "pk_live_", "glpat-", "npm_", "AIza"]) + some(alnum, 20, 40),
        lambda: ".".join(["eyJ" + some(alnum, 16, 30), "eyJ" + some(alnum, 20, 40), some(alnum + "-_", 30, 43)]),
        lambda: some(alnum, 5, 9) + "-" + some(alnum, 8, 12) + "-" + some(alnum, 8, 12),
        lambda: some(upper, 24, 40),
        lambda: some(string.ascii_letters, 20, 40),
    ]
    harmless = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(["T", "-", "_"]) + f"{r.randint(0, 23):02}-{r.randint(0, 59):02}" + word(),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + "/" + str(r.randint(1, 9999)),
        lambda: "_".join(word() for _ in range(r.randint(2, 5))) + "_v" + str(r.randint(1, 99)),
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + str(r.randint(1, 2030)),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))) + str(r.randint(0, 99)),
        lambda: "v" + ".".join(str(r.randint(0, 40)) for _ in range(r.randint(3, 5))) + "-" + r.choice(["alpha", "beta", "release", "snapshot"]) + str(r.randint(0, 9)),
        lambda: ("".join(str(r.randint(0, 9)) for _ in range(r.randint(16, 22)))) + r.choice(["kg", "px", "EUR", "x", "m"]),
        lambda: word() + "." + word() + str(r.randint(1, 999)) + "." + r.choice(["example.com", "example.org", "html", "json", "tar.gz"]),
        lambda: r.choice("abcxyz") * r.randint(10, 20) + "1" * r.randint(6, 12),
        lambda: "".join(word() for _ in range(r.randint(4, 8))) + str(r.randint(0, 9)),
        lambda: "-".join([str(r.randint(100, 999)), str(r.randint(10, 99)), word(), word(), str(r.randint(1000, 9999))]),
        lambda: "=" * r.randint(8, 20) + word() + str(r.randint(1, 9)) + "=" * r.randint(8, 20),
        lambda: "".join(word() for _ in range(r.randint(3, 8))),
        lambda: r.choice(["_", "-", ".", "/"]).join(word() for _ in range(r.randint(3, 8))),
        lambda: "".join(str(r.randint(0, 9)) for _ in range(r.randint(16, 24))),
        lambda: r.choice(["mail", "www", "srv", "host"]) + str(r.randint(0, 99)) + "." + r.choice(["example.com", "example.org", word() + ".net"]),
        lambda: ("".join(word() for _ in range(r.randint(3, 8))).capitalize() + r.choice(["", ".", "-"])),
        lambda: r.choice("=-_.") * r.randint(16, 70),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 7))),
        lambda: "".join(word().upper() for _ in range(r.randint(3, 7))),
    ]
    lead = ["key: ", "key=", "auth = ", "Authorization: Bearer ", "credential ", "AWS_KEY=", "pwd ", "login with ", ""]
    plain = ["see ", "file ", "version ", "id ", "at ", "ref ", "from ", "", ""]
    out = []
    while len(out) < n:
        label = len(out) % 2
        own = (r.choice(secret) if label else r.choice(harmless))()
        if len(own) < 16 or not own.isascii():
            continue
        a, b = 0, len(own)
        if inside:
            ends = ["", ""]
            while len(own) + sum(map(len, ends)) <= OWN or not all(ends):
                ends[r.randrange(2)] += r.choice(["/", "/", ".", "=", "-"]) + r.choice(harmless)()
            ends[0] = ends[0][1:] + r.choice("/=.")
            if not "".join(ends).isascii():
                continue
            a, b, own = len(ends[0]), len(ends[0]) + len(own), ends[0] + own + ends[1]
        quote = r.choice(["", "", '"', "'"])
        head = prose(r.randint(0, 6)) + " " + (r.choice(lead) if r.random() < (0.6 if label else 0.15) else r.choice(plain)) + quote
        text = (head + own + quote + r.choice([" ", ".\n", ", ", "\n"]) + prose(r.randint(0, 3))).encode()
        start = len(head.encode())
        out.append((text, start, start + len(own), label, start + a, start + b))
    return out


def _used_pieces(finding: tuple) -> list[tuple[int, int]]:
    """Pieces of a finding (text, start, end, label, maybe where it is inside) that its label holds for."""
    _, start, end, label, *at = finding
    found = pieces(start, end)
    if not label or not at:
        return found
    enough = min(at[1] - at[0], OWN // 2)
    return [(a, b) for a, b in found if min(b, at[1]) - max(a, at[0]) >= enough]


class SecretModel:
    def __init__(self, net: ByteNet, slope: float, shift: float, threshold: float):
        self.net, self.slope, self.shift, self.threshold = net, slope, shift, threshold

    def scores(self, found: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Probability that each (text, start, end) is a secret, or holds one."""
        return sigmoid(self.slope * _logits(self.net, found) + self.shift)


def _logits(net: ByteNet, found: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The largest of each one's pieces."""
    parts = [pieces(a, b) for _, a, b in found]
    asked = [(t, *p) for (t, _, _), own in zip(found, parts) for p in own]
    out = []
    for k in range(0, len(asked), 256):
        windows, marks = map(np.stack, zip(*(window(*f) for f in asked[k : k + 256])))
        out.append(net.head(_features(net, windows, marks)[2]))
    count = np.array([len(own) for own in parts], np.int64)
    return np.maximum.reduceat(np.concatenate(out), np.cumsum(count) - count) if out else np.zeros(0)


def _features(net: ByteNet, windows: np.ndarray, marks: np.ndarray):
    x = net.looked_up(windows, marks)
    out = net.responses(x)
    place = out.argmax(axis=1)
    top = np.maximum(np.take_along_axis(out, place[:, None], axis=1)[:, 0], 0)
    # the mean over the candidate tells how evenly a filter responds, which one response can't
    own = marks[:, : out.shape[1]]
    mean = (np.maximum(out, 0) * own).sum(axis=1) / own.sum(axis=1)
    return x, (place, top, out, own), np.concatenate([top, mean], axis=1).astype(np.float32)


def missable(n: int, recall: float = RECALL, confidence: float = CONFIDENCE) -> int:
    """How many of n secrets may be missed so that, with that confidence, recall holds for others too (a binomial bound; 0 at least)."""
    chance, total, m = recall**n, 0.0, 0
    while m < n:
        total += chance
        if total > 1 - confidence:
            break
        chance *= (n - m) / (m + 1) * (1 - recall) / recall
        m += 1
    return max(0, m - 1)


def train(findings: list[tuple], seed: int = SEED) -> SecretModel:
    """findings as labelled_findings gives them, the last two fields optional. A tenth is kept back for calibration, a quarter for the threshold.

    With fewer than 20 findings, or only one kind of them, there is nothing to learn: every candidate gets the share of
    secrets among them (half for none), and counts as one if that is above a half. Repeated findings weigh as often as they come.
    """
    net = ByteNet(4, 1, DIM, FILTERS, 2 * FILTERS, HIDDEN, seed, channels=1)
    n_secrets = sum(f[3] for f in findings)
    if len(findings) < 20 or n_secrets in (0, len(findings)):
        net.p["out"][:] = 0
        share = (n_secrets + 1) / (len(findings) + 2)
        return SecretModel(net, 1.0, float(np.log(share / (1 - share))), float(np.nextafter(0.5, 1)))
    order = np.random.default_rng(seed).permutation(len(findings))
    cuts = len(order) // 10, len(order) // 10 + len(order) // 4
    fitted, kept, learnt = ([findings[i] for i in part] for part in np.split(order, cuts))
    parts = [(f[0], *p, f[3]) for f in learnt for p in _used_pieces(f)]
    windows, marks = map(np.stack, zip(*(window(*f[:3]) for f in parts)))
    labels, used = np.array([f[3] for f in parts], np.float64), np.arange(len(parts))
    adam, r = Adam(net.p, 5e-3), np.random.default_rng(seed + 1)
    for k in range(PASSES):
        adam.rate = 5e-3 * (1 - k / PASSES) + 3e-4
        mixed = r.permutation(used)
        for a in range(0, len(mixed), 64):
            ids = mixed[a : a + 64]
            x, (place, top, out, own), features = _features(net, windows[ids], marks[ids])
            d_logit = ((sigmoid(net.head(features)) - labels[ids]) / len(ids)).astype(np.float32)
            grads = net.no_grads()
            d = net.head_back(features, d_logit, grads)
            net.filters_back(windows[ids], x, place, np.where(top > 0, d[:, :FILTERS], 0).astype(np.float32), grads)
            spread = np.where(out > 0, own, 0) / own.sum(axis=1)[:, None] * d[:, None, FILTERS:]
            grads["filter"] += net.patches(x).reshape(-1, net.width * net.dim).T @ spread.reshape(-1, FILTERS)
            grads["shift"] += spread.sum(axis=(0, 1))
            adam.step({n: g.astype(np.float32) for n, g in grads.items()})
    slope, shift = calibration(_logits(net, [f[:3] for f in fitted]), np.array([f[3] for f in fitted], np.float64))
    logits, own = _logits(net, [f[:3] for f in kept]), np.array([f[3] for f in kept], np.float64)
    score, long = sigmoid(slope * logits + shift), np.array([f[2] - f[1] > OWN for f in kept])
    # short and long candidates each have to be found
    good = [np.sort(score[(own == 1) & (long == k)]) for k in (False, True)]
    threshold = float(min([g[missable(len(g))] for g in good if len(g)], default=0.5))
    precision = float(own[score >= threshold].mean())
    if precision < PRECISION:
        warnings.warn(f"at recall {RECALL}, threshold {threshold:.3f}, the precision on kept-back findings is {precision:.3f}", stacklevel=2)
    return SecretModel(net, slope, shift, threshold)


@lru_cache(maxsize=1)
def default_model() -> SecretModel:
    return train(labelled_findings(FINDINGS, SEED) + labelled_findings(FINDINGS // 2, SEED + 1, inside=True))


def find(texts: list[bytes], model: SecretModel) -> list[list[tuple[int, int, int, float]]]:
    """Per text: (start, kind, end, score) in bytes, sorted; spans of patterns have score 1."""
    out, asked = [], []
    for i, data in enumerate(texts):
        own = base_spans(data)
        out.append([(*s, 1.0) for s in own])
        asked += [(i, a, b) for a, b in candidates(data)]
    for (i, a, b), p in zip(asked, model.scores([(texts[i], a, b) for i, a, b in asked])):
        if p >= model.threshold and not any(s <= a and b <= e for s, k, e, _ in out[i] if k < 3):
            out[i].append((a, 3, b, float(p)))
    return [sorted(s) for s in out]


def in_code_points(data: bytes, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    if not spans or data.isascii():
        return spans
    at, n, where = 0, 0, {}
    for x in sorted({x for s in spans for x in (s[0], s[2])}):
        n += len(data[at:x].decode())
        at = x
        where[x] = n
    return [(where[a], k, where[b], p) for a, k, b, p in spans]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _find_batches(batches, model: SecretModel, text: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in in_code_points(t, s)] for t, s in zip(texts, find(texts, model))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])


def with_spans(df: DataFrame, text: str = "text", model: SecretModel | None = None) -> DataFrame:
    """df with an array of its secrets' kind, start, end (code points, end exclusive) and score; none for null texts.

    A column named spans is replaced; other columns, repeated rows and nulls in them stay as they are.
    """
    keep = [c for c in df.columns if c != "spans"]
    schema = schema_of(df, keep, "spans array<struct<kind:string,start:int,end:int,score:double>>")
    return mapped(df.select(*[F.col(f"`{c}`") for c in keep]), partial(_find_batches, model=model or default_model(), text=text), schema)


def _redact_batches(batches, model: SecretModel, text: str, by: str):
    for batch in batches:
        texts = batch.column(text).to_pylist()
        data = [(t or "").encode() for t in texts]
        out = []
        for t, d, spans in zip(texts, data, find(data, model)):
            parts, at = [], 0
            for a, _, b, _ in spans:
                if b <= at:
                    continue
                if a >= at:
                    parts += [d[at:a], by.encode()]
                at = b
            out.append(t if not spans else b"".join([*parts, d[at:]]).decode())
        k = batch.schema.get_field_index(text)
        yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))


def redact(df: DataFrame, text: str = "text", by: str = "[SECRET]", model: SecretModel | None = None) -> DataFrame:
    """df with each secret in its texts replaced; spans that overlap become one. Every row and column stays."""
    return mapped(df, partial(_redact_batches, model=model or default_model(), text=text, by=by), df.schema)


def _digest_batches(batches, model: SecretModel):
    for batch in batches:
        texts = batch.column("data").to_pylist()
        rows = []
        for t, spans in zip(texts, find(texts, model)):
            spans = in_code_points(t, spans)
            own = [s for s in spans if s[1] < 3]
            rows.append((*(sum(s[1] == k for s in own) for k in range(3)), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", *names])


def secrets(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """Per document the number of secrets of each kind, a digest of these, and all spans; null counts as empty."""
    return mapped(
        docs.select("doc_id", utf8("text").alias("data")), partial(_digest_batches, model=model or default_model()), f"doc_id {kind_of(docs, 'doc_id')}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
