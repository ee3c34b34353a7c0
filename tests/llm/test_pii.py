import itertools
import time

import numpy as np
import pytest
from conftest_llm import keep_extra

from portolan.llm import pii as P

PARAMS = P.PiiParams()


@pytest.fixture(scope="module")
def weights():
    return P.for_inference(P.train(PARAMS))


def test_held_out_accuracy(weights):
    held = P.labelled(600, 987654)
    found = P.spans_of([t for t, _ in held], weights, PARAMS)
    hit = sum(len({s[:2] for s in f} & {s[:2] for s in g}) for f, (_, g) in zip(found, held))
    assert hit / sum(len(f) for f in found) > 0.93
    assert hit / sum(len(g) for _, g in held) > 0.93


def test_what_documents_hold_is_masked(weights):
    secrets = ["+1 (415) 555-0134", "hsr.29@mail5.example.com", "152.143.123.131", "4785380592391139", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    text = "Thanedble of the shre. " + " erthat the in hein, ".join(f'token = "{s}"' if len(s) == 40 else s for s in secrets) + " and attion the."
    masked = P.masked(text, P.spans_of([text], weights, PARAMS)[0])
    assert not [s for s in secrets if s in masked]
    assert masked.startswith("Thanedble of the shre. ") and masked.endswith(" and attion the.")


def test_clean_text_is_left_alone(weights):
    clean = "In 1999 the 12 members met at 10:30 and paid $3,200.50 for 45% of it. See section 3.1.4, page 77; call the office (room 12) by 2024-05-01." * 3
    assert P.spans_of([clean, "", "x"], weights, PARAMS) == [[], [], []]


def test_windows_don_t_show(weights):
    """A value is found wherever the seams between windows lie, and as in one window."""
    values = ["pathe.42@mail8.example.com", "+1 (017) 555-7713", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    for v in values:
        for shift in range(900, 1060, 13):
            filler = ("the and thing erthat of in. " * 80)[:shift]
            text = filler + " " + v + " " + "of the shre and. " * 120
            spans = P.spans_of([text], weights, PARAMS)[0]
            assert [text[a:b] for a, b, _ in spans] == [v], (v, shift)


def naive(text, w, lean):
    """The labels' scores of one text, written out for each character in doubles, from the weights as trained."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    h = w["rec"].shape[1]
    squash = lambda x: x / np.sqrt(1 + x * x)
    total = np.zeros((len(text), len(P.KINDS))) + w["bias"]
    total[:, 1:] += lean
    for side, order in ((0, range(len(text))), (1, range(len(text) - 1, -1, -1))):
        hid, c = np.zeros(h), np.zeros(h)
        for t in order:
            z = w["tab"][side, min(ord(text[t]), 128)] + hid @ w["rec"][side]
            i, f, o = ((1 + squash(z[a * h : (a + 1) * h] / 2)) / 2 for a in range(3))
            c = f * c + i * squash(z[3 * h :])
            hid = o * squash(c)
            total[t] += hid @ w["out"][side]
    return total


def test_decoder_against_all_paths(weights):
    """Scores as written out above; labels as the best of all label paths."""
    trained = P.train(PARAMS)
    r = np.random.default_rng(3)
    texts = ["a@b.cc", "ä1.2.3", "x", "12-345", "the of"] + ["".join(r.choice(list("a1@. -+é\n"), 5)) for _ in range(12)]
    unsure = {k: v * np.float32(0.05) if k in ("trans", "first", "last") else v for k, v in trained.items()}
    for w in (trained, unsure):
        ready = P.for_inference(w)
        for text in texts:
            want = naive(text, w, PARAMS.lean)
            em = P.emissions(P.encode(text)[:, None], np.array([len(text)]), ready)
            np.testing.assert_allclose(em[:, 0], want[:, 1:] - want[:, :1], atol=2e-4)
            paths = np.array(list(itertools.product(range(len(P.KINDS)), repeat=len(text))))
            score = want[np.arange(len(text)), paths].sum(1) + w["first"][paths[:, 0]] + w["last"][paths[:, -1]] + w["trans"][paths[:, :-1], paths[:, 1:]].sum(1)
            mine = P.viterbi(em, ready)[:, 0]
            assert score[(paths == mine).all(1)][0] > score.max() - 1e-3, text


def test_short_secrets_and_figures_that_are_none(weights):
    said = {"My key: password: hunter2xyz and then": "My key: password: <SECRET> and then", "api_key=ab12cd34 is set": "api_key=<SECRET> is set"}
    same = ["see version 10.0.19041.1 now", "ISBN 978-3-16-148410-0 is good", "your order no. 123456789012 has shipped", "password: required field", "the password is wrong"]
    for text, want in [*said.items(), *zip(same, same)]:
        assert P.masked(text, P.spans_of([text], weights, PARAMS)[0]) == want


def test_weights_are_kept(spark, monkeypatch):
    runs, train = [], P.train
    monkeypatch.setattr(P, "train", lambda p: runs.append(p) or train(p))
    p = P.PiiParams(hidden=3, steps=2, seed=time.time_ns() % 2**31)  # the shared folder may keep what an earlier run left
    first, again = P.weights_of(spark, p), P.weights_of(spark, p)
    assert runs == [p] and all((first[k] == again[k]).all() for k in first)


def test_skipping_is_exact(weights):
    texts = [t for t, _ in P.labelled(150, 4)]
    ids = P.encode("".join(t.ljust(200)[:200] for t in texts)).reshape(-1, 200).T
    em = P.emissions(np.ascontiguousarray(ids), np.full(ids.shape[1], 200), weights)
    may = P._may_hold(em, weights)
    assert (P.viterbi(em, weights)[:, ~may] == 0).all() and (~may).any() and may.any()


def test_gradient():
    p = P.PiiParams(hidden=3)
    w = {k: v.astype(np.float64) for k, v in P._init(p).items()}
    r = np.random.default_rng(0)
    ids, gold = r.integers(97, 110, (2, 9)).astype(np.uint8), r.integers(0, len(P.KINDS), (2, 9))
    _, grad = P._loss_grad({k: v.astype(np.float32) for k, v in w.items()}, ids, gold)
    for k in w:
        flat = np.argmax(np.abs(grad[k]))
        at = np.unravel_index(flat, grad[k].shape)
        eps, out = 1e-2, []
        for s in (1, -1):
            moved = {a: b.copy() for a, b in w.items()}
            moved[k][at] += s * eps
            out.append(P._loss_grad({a: b.astype(np.float32) for a, b in moved.items()}, ids, gold)[0])
        assert abs((out[0] - out[1]) / (2 * eps) - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at])), k


def test_packed_windows_equal_single_ones(weights):
    texts = ["call +1 (017) 555-7713 now", "x" * 300, "a@b.example.com"]
    sizes = np.array([300, 26, 15])
    ids = np.zeros((300, 3), np.uint8)
    for col, t in enumerate([texts[1], texts[0], texts[2]]):
        ids[: len(t), col] = P.encode(t)
    em = P.emissions(ids, sizes, weights)
    for col, t in enumerate([texts[1], texts[0], texts[2]]):
        alone = P.emissions(P.encode(t)[:, None], np.array([len(t)]), weights)
        np.testing.assert_allclose(em[: len(t), col], alone[:, 0], atol=1e-4)


def test_table(docs):
    v = "pathe.42@mail8.example.com"
    df = docs([(1, None), (2, ""), (3, f"write to {v} today"), (3, f"write to {v} today"), (None, "nothing here."), (5, "the and of. " * 30_000 + v), (6, "naïve café 😀 " + v)])
    out = P.mask_pii(df, spans="v")
    assert out.columns == [*df.columns, "v_"]
    rows = {str(r["doc_id"]): r for r in out.collect()}
    assert out.count() == 7 and rows["1"]["text"] is None and rows["1"]["n_chars"] is None and rows["2"]["text"] == ""
    assert rows["3"]["text"] == "write to <EMAIL> today" and rows["3"]["n_chars"] == 22
    assert [(s["start"], s["end"], s["kind"]) for s in rows["3"]["v_"]] == [(9, 9 + len(v), "EMAIL")]
    assert rows["None"]["text"] == "nothing here."
    assert rows["5"]["text"] == "the and of. " * 30_000 + "<EMAIL>" and rows["6"]["text"] == "naïve café 😀 <EMAIL>"
    keep_extra(out, df)
    assert P.mask_pii(docs([])).count() == 0
