"""Personal data and secrets, found by a character-level BiLSTM with a CRF on top and masked.

The network is trained in numpy on spans that ``labelled`` writes into invented
text; nothing is downloaded. A text is read whole, as overlapping windows whose
labels are decoded together and reconciled over the document.
"""

from __future__ import annotations

import functools
import hashlib
import io
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from portolan.session import private_name, shared_dir, ship_code

KINDS = ("O", "EMAIL", "PHONE", "IP", "NUMBER", "SECRET")
OTHER, PAD, VOCAB = 128, 129, 130
SLICE_CHARS = 4_000_000  # of whole texts that are decoded at once
REMEMBERED = 100_000  # texts of a task whose spans are kept at hand


@dataclass(frozen=True)
class PiiParams:
    hidden: int = 16
    window: int = 1024
    overlap: int = 80  # longer than the spans, so that each lies whole within some window's own half of the overlap
    batch: int = 1024
    steps: int = 600
    rounds: int = 2  # how often a text is trained on
    train_batch: int = 64
    train_length: int = 112
    rate: float = 0.02
    lean: float = 0.6  # added to every kind's score when decoding: missing personal data is worse than masking a figure
    seed: int = 11


# Labelled spans


def _filler(r: random.Random) -> str:
    syllables = r.choice(("th er an in on re ti es ed of st nt sh he ou wh ble ing tion ly", "en er ch sch ei un ge be ver zu lich keit ung heit ß ä ö ü pf", "de le la que é è ou ai en re ment tion eau oi ê ç", "de la que ción es ar os ado ie ra ñ ó í mente ja"))
    s = syllables.split()
    out = []
    for _ in range(r.randint(3, 24)):
        w = "".join(r.choice(s) for _ in range(r.randint(1, 5)))
        x = r.random()
        if x < 0.05:
            w = w.capitalize()
        elif x < 0.085:
            w = str(r.choice((r.randint(0, 9), r.randint(10, 99), r.randint(100, 99999), r.randint(1900, 2030), f"{r.random() * 100:.2f}", f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"{r.randint(1890, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}", f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(1890, 2040)}", f"{r.randint(1890, 2040)}-{r.randint(1890, 2040)}", f"{r.randint(1, 999)}-{r.randint(1, 999)}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", f"${r.randint(1, 99)},{r.randint(100, 999)}", f"{r.randint(1, 99)}%", f"({r.randint(1, 99)})", f"#{r.randint(1, 9999)}", f"{r.randint(1, 999)},{r.randint(100, 999)},{r.randint(100, 999)}")))
        elif x < 0.09:
            w = r.choice(("http://", "https://www.")) + w + ".example.com/" + r.choice(s)
        elif x < 0.095:
            w = r.choice(("token", "key", "password", "password:", "@", "+", "=", '"', "the token is", "phone:", "email:", "call", "|", "licensed under CC BY-NC 4.0.", "Version 2.0."))
        elif x < 0.1:
            d = "".join(r.choice("0123456789") for _ in range(13))
            w = r.choice((f"ISBN 978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"ISBN 978{d[:10]}", f"ISBN {d[:10]}", f"order {d[: r.randint(6, 12)]}", f"order no. {d[: r.randint(6, 12)]}", f"invoice #{d[: r.randint(6, 12)]}", f"version {d[0]}.{d[1]}.{d[2:7]}.{d[8]}", f"build {d[: r.randint(4, 8)]}"))
        elif x < 0.105:
            w = w + w + w + w + w
        out.append(w)
    style = r.random()
    if style < 0.06:
        text = "!! ".join(w.upper() for w in out) + "!!"
    elif style < 0.14:
        text = " ".join(w + r.choice(("***", "%%%", "$$$", "&&&", "###")) for w in out)
    elif style < 0.18:
        text = " | ".join(out)
    else:
        text = r.choice((" ", " ", ", ")).join(out)
    return text + r.choice((".", ".", "", ",", "\n", ".\n", "?", ":"))


def _secret_word(r: random.Random, alphabet: str, lo: int, hi: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))


def _value(r: random.Random) -> tuple[int, str, str, str]:
    """(kind, what stands before, the value, what stands after)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    low, hexa, alnum = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda a=2, b=9: _secret_word(r, low, a, b)
    kind = r.choice((1, 2, 3, 3, 4, 5))
    mixed = r.random() < 0.75
    if kind == 1:
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}.{d(2)}", f"{word()}_{word()}", f"{word()}{d(r.randint(1, 4))}", f"{word(1, 1)}{word()}", f"{word()}-{word()}", f"{word()}+{word()}", f"{word().capitalize()}.{word().capitalize()}"))
        host = r.choice((f"{word()}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'edu', 'co.uk'))}", f"mail{d(1)}.example.com", "example.com", f"{word()}.example.{r.choice(('com', 'org', 'net'))}", f"{word()}-{word()}.com", f"{word()}{d(1)}.{word()}.org"))
        v = f"{name}@{host}"
    elif kind == 2:
        v = r.choice((f"+1 ({d(3)}) 555-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"+49 {d(3)} {d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+{d(11)}"))
    elif kind == 3:
        v = ".".join(str(r.randint(*r.choice(((0, 255), (0, 255), (10, 99), (0, 9)) if mixed else ((10, 99), (10, 255))))) for _ in range(4)) if r.random() < 0.9 else ":".join(_secret_word(r, hexa, 1, 4) for _ in range(8))
    elif kind == 4:
        v = r.choice((d(16), d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15), f"{d(4)} {d(6)} {d(5)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", _secret_word(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2, 2) + d(20), f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"))
    else:
        v = r.choice((_secret_word(r, hexa, 40, 40), _secret_word(r, hexa, 16, 28), _secret_word(r, hexa, 32, 64), _secret_word(r, alnum, 32, 48), "AKIA" + _secret_word(r, alnum[:26] + "0123456789", 16, 16), "sk-" + _secret_word(r, alnum, 24, 48), "ghp_" + _secret_word(r, alnum, 36, 36), "eyJ" + _secret_word(r, alnum, 20, 50)))
    before = after = ""
    if kind == 5 and r.random() < 0.25:
        v = _secret_word(r, r.choice((low + "0123456789", alnum)), 5, 14)
        at = r.randint(1, len(v))
        v = v[:at] + d(1) + v[at:]
        before = r.choice(("password: ", "password=", "passwd: ", "pwd=", "api_key=", "secret=", "secret: ", "key: ", "key=", "token=", "token: ", 'password = "'))
        after = '"' if before[-1] == '"' else ""
    elif kind == 5 and r.random() < 0.7:
        before, after = r.choice((('token = "', '"'), ('token = "', '"'), ("token: ", ""), ('api_key="', '"'), ("secret=", ""), ("password: ", ""), ("password=", ""), ("key = '", "'")))
    elif r.random() < 0.15:
        before = r.choice(("email: ", "tel ", "phone: ", "IP ", "from ", "card ", "(", '"', "SSN "))
        after = {"(": ")", '"': '"'}.get(before, "")
    if r.random() < 0.06:
        before, v, after = before.upper(), v.upper(), after
    return kind, before, v, after


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` invented texts with the spans (start, end, kind) that were put into them."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = _filler(r) if r.random() < 0.8 else "", []
        for _ in range(r.choice((0, 1, 1, 2, 2, 3))):
            kind, before, v, after = _value(r)
            text += r.choice((" ", " ", " ", "\n")) if text else ""
            spans.append((len(text) + len(before), len(text) + len(before) + len(v), kind))
            text += before + v + after + r.choice(("", "", "", "", ".", ",", "!!", "***", "%%%", "$$$", ";"))
            if r.random() < 0.9:
                text += r.choice((" ", " ", " ", "\n")) + _filler(r)
        out.append((text, spans))
    return out


# The network: its gates squash with x / sqrt(1 + x^2), which numpy computes in a fifth of the time of tanh


def squash(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.multiply(x, x, out=out)
    out += np.float32(1)
    np.sqrt(out, out=out)
    return np.divide(x, out, out=out)


def _slope(y: np.ndarray) -> np.ndarray:
    """The slope of ``squash`` where its value is ``y``."""
    x = 1 - y * y
    return x * np.sqrt(x)


def encode(text: str) -> np.ndarray:
    """Code points; what isn't ASCII is one symbol. Lone surrogates are passed like any other character."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.uint8)


def _init(p: PiiParams) -> dict[str, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(p.seed))
    h, k = p.hidden, len(KINDS)
    w = {"tab": g.normal(0, 0.3, (2, VOCAB, 4 * h)), "rec": g.normal(0, h**-0.5, (2, h, 4 * h)), "out": g.normal(0, h**-0.5, (2, h, k)), "bias": np.zeros(k), "trans": np.zeros((k, k)), "first": np.zeros(k), "last": np.zeros(k)}
    w["tab"][:, :, h : 2 * h] += 1.0
    return {a: x.astype(np.float32) for a, x in w.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _loss_grad(w: dict[str, np.ndarray], ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the label paths of a batch (B, T), and its gradient."""
    b, t_max = ids.shape
    h = w["rec"].shape[1]
    k = len(KINDS)
    both = np.stack([ids, ids[:, ::-1]])
    hs, cs, gates, tcs = (np.zeros((t_max + 1, 2, b, h), np.float32), np.zeros((t_max + 1, 2, b, h), np.float32), np.empty((t_max, 2, b, 4 * h), np.float32), np.empty((t_max, 2, b, h), np.float32))
    side = np.arange(2)[:, None]
    for t in range(t_max):
        z = w["tab"][side, both[:, :, t]] + hs[t] @ w["rec"]
        s = 0.5 + 0.5 * squash(0.5 * z[..., : 3 * h])
        g = squash(z[..., 3 * h :])
        cs[t + 1] = s[..., h : 2 * h] * cs[t] + s[..., :h] * g
        tcs[t] = squash(cs[t + 1])
        hs[t + 1] = s[..., 2 * h :] * tcs[t]
        gates[t, ..., : 3 * h], gates[t, ..., 3 * h :] = s, g
    fwd, bwd = hs[1:, 0], hs[1:, 1][::-1]
    em = fwd @ w["out"][0] + bwd @ w["out"][1] + w["bias"]  # (T, B, K)
    run = np.empty((t_max, 2, b, k), np.float32)  # from both ends at once, each with the score of where it is
    way = np.stack([w["trans"], w["trans"].T])[:, None]
    run[0, 0], run[0, 1] = em[0] + w["first"], em[-1] + w["last"]
    for t in range(1, t_max):
        run[t] = _lse(run[t - 1][..., None] + way, 2)
        run[t, 0] += em[t]
        run[t, 1] += em[-1 - t]
    alpha, beta = run[:, 0], run[::-1, 1] - em
    z = _lse(alpha[-1] + w["last"], 1)
    y = gold.T
    rows = np.arange(b)
    score = w["first"][y[0]] + w["last"][y[-1]] + np.take_along_axis(em, y[:, :, None], 2).sum((0, 2)) + w["trans"][y[:-1], y[1:]].sum(0)
    one = np.eye(k, dtype=np.float32)[y]
    d_em = (np.exp(alpha + beta - z[None, :, None]) - one) / b
    pair = np.exp(alpha[:-1, :, :, None] + w["trans"] + (em[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1)) / b
    hit = np.zeros((k, k), np.float32)
    np.add.at(hit, (y[:-1].ravel(), y[1:].ravel()), 1.0 / b)
    grad = {"trans": pair - hit, "first": d_em[0].sum(0), "last": (np.exp(alpha[-1] + w["last"] - z[:, None]) - one[-1]).sum(0) / b, "bias": d_em.sum((0, 1))}
    flat = d_em.reshape(-1, k)
    grad["out"] = np.stack([fwd.reshape(-1, h).T @ flat, np.ascontiguousarray(bwd).reshape(-1, h).T @ flat])
    d_h = np.stack([d_em @ w["out"][0].T, (d_em @ w["out"][1].T)[::-1]], 1)  # (T, 2, B, H)
    d_z = np.empty_like(gates)
    nh = np.zeros((2, b, h), np.float32)
    nc = np.zeros((2, b, h), np.float32)
    back = w["rec"].transpose(0, 2, 1)
    steep = np.concatenate([0.25 * _slope(2 * gates[..., : 3 * h] - 1), _slope(gates[..., 3 * h :])], -1)
    c_steep = _slope(tcs)
    for t in range(t_max - 1, -1, -1):
        i, f, o, g = (gates[t, ..., a * h : (a + 1) * h] for a in range(4))
        dh = d_h[t] + nh
        dc = nc + dh * o * c_steep[t]
        d_z[t, ..., :h] = dc * g
        d_z[t, ..., h : 2 * h] = dc * cs[t]
        d_z[t, ..., 2 * h : 3 * h] = dh * tcs[t]
        d_z[t, ..., 3 * h :] = dc * i
        d_z[t] *= steep[t]
        nc = dc * f
        nh = d_z[t] @ back
    grad["rec"] = np.stack([hs[:-1, s].reshape(-1, h).T @ d_z[:, s].reshape(-1, 4 * h) for s in range(2)])
    grad["tab"] = np.zeros_like(w["tab"])
    for s in range(2):
        symbol = np.zeros((t_max * b, VOCAB), np.float32)
        symbol[np.arange(t_max * b), both[s].T.ravel()] = 1
        grad["tab"][s] = symbol.T @ d_z[:, s].reshape(-1, 4 * h)
    return float((z - score[rows]).mean()), grad


def _windows_for_training(p: PiiParams, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(p.seed + 1)
    ids, gold = np.full((n, p.train_length), PAD, np.uint8), np.zeros((n, p.train_length), np.int64)
    for row, (text, spans) in enumerate(labelled(n, p.seed)):
        tags = np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            tags[a:b] = kind
        x = encode(text)
        if len(x) > p.train_length:
            if spans and r.random() < 0.9:
                a, b, _ = r.choice(spans)
                at = min(max(0, r.randint(b - p.train_length, a)), len(x) - p.train_length) if b - a < p.train_length else a
            else:
                at = r.randint(0, len(x) - p.train_length)
            at = max(0, min(at, len(x) - p.train_length))
            x, tags = x[at : at + p.train_length], tags[at : at + p.train_length]
        ids[row, : len(x)], gold[row, : len(x)] = x, tags
    return ids, gold


@functools.lru_cache(maxsize=4)
def train(p: PiiParams = PiiParams()) -> dict[str, np.ndarray]:
    """The network's weights: ``steps`` steps of Adam with a falling rate. The same parameters always give the same weights."""
    w = _init(p)
    size = -(-p.steps * p.train_batch // p.rounds)
    ids, gold = _windows_for_training(p, size)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(p.steps):
        at = np.arange(step * p.train_batch, (step + 1) * p.train_batch) % size
        _, grad = _loss_grad(w, ids[at], gold[at])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        rate = p.rate * min(1.0, (step + 1) / 20) * (0.05 + 0.95 * (1 - step / p.steps))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return w


def weights_of(spark: SparkSession, p: PiiParams) -> dict[str, np.ndarray]:
    """The weights of ``train``, kept in the shared folder under the parameters and this code, so that later sessions needn't train."""
    with open(__file__, "rb") as f:
        name = hashlib.sha256(repr(p).encode() + f.read()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/portolan"
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{folder}/pii-{name}.npz")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        kept = spark.read.format("binaryFile").load(path.toString()).select("content").first()
        with np.load(io.BytesIO(bytes(kept["content"]))) as found:
            return dict(found)
    w = train(p)
    data = io.BytesIO()
    np.savez(data, **w)
    draft = jvm.Path(f"{folder}/pii-{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    if not fs.rename(draft, path):  # another session was first, with the same weights
        fs.delete(draft, False)
    return w


def for_inference(w: dict[str, np.ndarray], lean: float = PiiParams.lean) -> dict[str, np.ndarray]:
    """The weights gate by gate, such that gates come from the same ``squash`` as the rest; emissions as differences to O.

    With gate(x) = (squash(x/2) + 1) / 2 the gates are halved arguments and a
    later factor: the state that is kept is twice the hidden one.
    """
    h = w["rec"].shape[1]
    half = np.repeat(np.float32([0.5, 0.5, 0.5, 1.0]), h)
    gate = lambda x: np.ascontiguousarray((x * half).reshape(2, x.shape[1], 4, h).transpose(0, 2, 1, 3))
    out = np.ascontiguousarray(w["out"][:, :, 1:] - w["out"][:, :, :1]) * np.float32(0.5)
    return {"tab": gate(w["tab"]), "rec": gate(w["rec"]) * np.float32(0.5), "out": out, "bias": w["bias"][1:] - w["bias"][0] + np.float32(lean), "trans": w["trans"], "first": w["first"], "last": w["last"]}


NEVER = np.float32(-1e9)


def emissions(ids: np.ndarray, sizes: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Scores (T, B, K-1) of the kinds against O for windows (T, B) whose ``sizes`` fall; NEVER beyond a window's end.

    At each step only the windows that reach so far are computed.
    """
    t_max, b = ids.shape
    h = w["rec"].shape[2]
    em = np.full((t_max, b, w["out"].shape[2]), NEVER, np.float32)
    active = np.searchsorted(-sizes, -np.arange(t_max), "left")  # windows longer than t
    for t in range(t_max):
        em[t, : active[t]] = w["bias"]
    tmp_all, score = np.empty((b, h), np.float32), np.empty((b, w["out"].shape[2]), np.float32)
    one, half = np.float32(1), np.float32(0.5)
    for side, order in ((0, range(t_max)), (1, range(t_max - 1, -1, -1))):
        tab, rec, out = w["tab"][side], w["rec"][side], w["out"][side]
        hid_all, c_all = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        n = -1
        for t in order:
            if n != active[t]:
                n = active[t]
                z, m, tmp, hid, c, sc = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32), tmp_all[:n], hid_all[:n], c_all[:n], score[:n]
                gates = z[:3]
            np.take(tab, ids[t, :n], axis=1, out=z, mode="clip")
            np.matmul(hid, rec, out=m)
            z += m
            np.multiply(z, z, out=m)
            m += one
            np.sqrt(m, out=m)
            z /= m
            gates += one
            c *= z[1]
            np.multiply(z[0], z[3], out=tmp)
            c += tmp
            c *= half
            squash(c, tmp)
            np.multiply(z[2], tmp, out=hid)
            np.matmul(hid, out, out=sc)
            em[t, :n] += sc
    return em


def viterbi(em: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Best label paths (T, B) for scores (T, B, K-1) against O."""
    t_max, b, _ = em.shape
    full = np.concatenate([np.zeros((t_max, b, 1), np.float32), em], 2)
    score = full[0] + w["first"]
    back = np.zeros((t_max, b, full.shape[2]), np.int8)
    for t in range(1, t_max):
        step = score[:, :, None] + w["trans"]
        back[t] = step.argmax(1)
        score = step.max(1) + full[t]
    path = np.zeros((t_max, b), np.int8)
    path[-1] = (score + w["last"]).argmax(1)
    for t in range(t_max - 1, 0, -1):
        path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
    return path


def _may_hold(em: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Windows for which the path of nothing but O isn't certain to be the best.

    What any run off O can win against O is at most, at each step, its best
    score with the best transition there is into a run, within one or out of
    it. Where no run's bound rises above zero, no path beats O throughout; so
    skipping those windows is exact.
    """
    trans, rel = w["trans"], w["trans"] - w["trans"][0, 0]
    enter, stay, leave = float(rel[0, 1:].max()), float(rel[1:, 1:].max()), float(rel[1:, 0].max())
    begin, end = float((w["first"][1:] - w["first"][0]).max()), float((w["last"][1:] - w["last"][0]).max())
    best = em[:, :, 0].copy()
    for k in range(1, len(trans) - 1):
        np.maximum(best, em[:, :, k], out=best)
    run = best[0] + max(begin, enter)
    top = run.copy()
    for m in best[1:]:
        run += stay
        np.maximum(run, enter, out=run)
        run += m
        np.maximum(top, run, out=top)
    return top + max(leave, end, 0.0) >= 0


def spans_of(texts: list[str], w: dict[str, np.ndarray], p: PiiParams) -> list[list[tuple[int, int, int]]]:
    """The spans (start, end, kind) of each text, in its characters."""
    lengths = np.array([len(x) for x in texts], np.int64)
    base = np.r_[0, np.cumsum(lengths)]
    ids = encode("".join(texts))
    labels = np.zeros(len(ids), np.int8)
    starts, sizes, own_from, own_to = [], [], [], []
    stride = p.window - p.overlap
    for i, n in enumerate(lengths.tolist()):
        if not n:
            continue
        at = list(range(0, max(n - p.overlap, 1), stride))
        for j, s in enumerate(at):
            e = min(n, s + p.window)
            starts.append(base[i] + s)
            sizes.append(e - s)
            own_from.append(0 if j == 0 else p.overlap // 2)  # each window has the labels up to the middle of an overlap
            own_to.append(e - s if j == len(at) - 1 else p.window - p.overlap + p.overlap // 2)
    starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    doubtful, scores = [], []
    for lo in range(0, len(order), p.batch):
        pick = order[lo : lo + p.batch]
        at = starts[pick][None, :] + np.arange(int(sizes[pick[0]]))[:, None]
        em = emissions(np.take(ids, at, mode="clip"), sizes[pick], w)
        some = np.flatnonzero(_may_hold(em, w))
        doubtful += pick[some].tolist()
        scores.append(em[:, some])
    if doubtful:
        full = np.full((len(scores[0]), len(doubtful), len(KINDS) - 1), NEVER, np.float32)
        lo = 0
        for em in scores:
            full[: len(em), lo : lo + em.shape[1]] = em
            lo += em.shape[1]
        path = viterbi(full, w)
        for col, k in enumerate(doubtful):
            a, b = own_from[k], own_to[k]
            labels[starts[k] + a : starts[k] + b] = path[a:b, col]
    edge = np.zeros(len(labels) + 1, bool)
    edge[base] = True
    edge[1:-1] |= labels[1:] != labels[:-1]
    cuts = np.flatnonzero(edge)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    run = cuts[:-1][labels[cuts[:-1]] > 0] if len(labels) else []
    for s in run:
        e = int(cuts[np.searchsorted(cuts, s, "right")])
        i = int(np.searchsorted(base, s, "right")) - 1
        found[i].append((int(s - base[i]), int(e - base[i]), int(labels[s])))
    return [reconcile(t, f) if f else f for t, f in zip(texts, found)]


_DATE = re.compile(r"(?:1[89]|20)\d\d-[01]\d-[0-3]\d|[0-3]?\d[./][01]?\d[./](?:1[89]|20)\d\d")
_UNBROKEN = (1, 3, 5)  # kinds that have no blank in them
_KEYWORD = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key)\s?[:=]\s?[\"']?$", re.I)


def _possible(kind: int, text: str, s: int, e: int) -> bool:
    """Whether text[s:e] can be of its kind at all."""
    v = text[s:e]
    if kind == 1:
        return "@" in v and len(v) >= 6
    if kind == 2:
        return sum(c.isdigit() for c in v) >= 7 and not _DATE.fullmatch(v)
    if kind == 3:
        parts = v.split(".")
        return all(x.isdigit() and int(x) < 256 for x in parts) if len(parts) == 4 else v.count(":") >= 2 and sum(c in "0123456789abcdefABCDEF" for c in v) >= 4
    if kind == 4:
        return sum(c.isdigit() for c in v) >= 9
    return len(v) >= 16 or len(v) >= 6 and any(c.isdigit() for c in v) and bool(_KEYWORD.search(text[max(0, s - 16) : s]))


def reconcile(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that begin and end with whole words, joined where they touch, without those that can't be of their kind."""
    grown: list[list[int]] = []
    parts = []
    for s, e, kind in sorted(spans):
        if kind in _UNBROKEN:
            words = [(s + m.start(), s + m.end(), kind) for m in re.finditer(r"\S+", text[s:e])]
            parts += [w for w in words if _possible(kind, text, w[0], w[1])] or words
        else:
            parts.append((s, e, kind))
    for s, e, kind in parts:
        while e > s and text[e - 1] in ".,;:!?\"')":
            e -= 1
        while s < e and text[s] in ("\"'" if kind == 2 else "\"'("):
            s += 1
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s == e:
            continue
        more = "._%+-@" if kind == 1 else "._-" if kind in (3, 5) else ""
        while s > 0 and (text[s - 1].isalnum() or text[s - 1] in more):
            s -= 1
        while e < len(text) and (text[e].isalnum() or (text[e] in more and e + 1 < len(text) and text[e + 1].isalnum())):
            e += 1
        if kind == 2:
            while s > 0 and text[s - 1] in "+(":
                s -= 1
        if grown and s - grown[-1][1] <= (2 if kind == grown[-1][2] and kind not in _UNBROKEN and not any(c.isalnum() or c == "\n" for c in text[grown[-1][1] : s]) else 0):
            longer = grown[-1][1] - grown[-1][0] < e - s
            grown[-1][1] = max(grown[-1][1], e)
            if longer:
                grown[-1][2] = kind
        else:
            grown.append([s, e, kind])
    return [(s, e, k) for s, e, k in grown if _possible(k, text, s, e)]


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"<{KINDS[kind]}>"]
        at = e
    return "".join([*out, text[at:]])


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def mask_pii(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", spans: str | None = None, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span replaced by ``<KIND>`` and ``n_chars``, if there is one, recounted.

    Every row stays. A null text stays null and an empty one empty; a text of
    any length is read whole. Equal texts get equal masks; other columns are
    passed on, and an empty table gives an empty table. With ``spans``, a
    column of that name (lengthened if it's taken) lists each span's place in
    the text as it was; the values themselves are never put out.
    """
    p = params
    ship_code(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(for_inference(weights_of(docs.sparkSession, p), p.lean))
    at = docs.columns.index(text)
    count_at = docs.columns.index(n_chars) if n_chars in docs.columns else None
    fields = list(docs.schema.fields)
    if spans:
        fields.append(T.StructField(private_name(docs, spans), _SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[tuple[int, int, int]]] = {}

        def known(texts: list[str]) -> list[list[tuple[int, int, int]]]:
            """The texts' spans; equal texts of a task are decoded once while they are remembered."""
            if len(seen) > REMEMBERED:
                seen.clear()
            names = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
            new = {k: x for k, x in zip(names, texts) if k not in seen}
            seen.update(zip(new, spans_of(list(new.values()), weights.value, p)))
            return [seen[k] for k in names]

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                column = batch.column(at)
                texts = []
                while hi < batch.num_rows and (size < SLICE_CHARS or hi == lo):
                    texts.append(column[hi].as_py())
                    size += len(texts[-1] or "")
                    hi += 1
                found = known([x or "" for x in texts])
                part = batch.slice(lo, hi - lo)
                cols = list(part.columns)
                if any(found):
                    texts = [masked(x, f) if f else x for x, f in zip(texts, found)]
                    cols[at] = pa.array(texts, part.schema.field(at).type)
                if count_at is not None:
                    cols[count_at] = pa.array([None if x is None else len(x) for x in texts], part.schema.field(count_at).type)
                names = list(part.schema.names)
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                    cols.append(pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in f] for f in found], kind))
                    names.append(fields[-1].name)
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi

    return docs.mapInArrow(run, T.StructType(fields))
