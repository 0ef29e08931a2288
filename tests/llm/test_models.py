"""Alignment, whitening and language-model scores against brute force on small tables with odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from riskloom.llm import crosswalk, recurrent, whitening
from riskloom.llm.common import remainder

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "ing", "on", "ñ", "é", "st", "a", "X", "9", "."]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    made = [None, "", " ", "  two", "\n\n", "\nhead", "a", "▁", "x▁y", "<|endoftext|> <s>", "日本語のテキスト 🙂🙂", "x" * 3000, "日本" * 400, "tab\tand  two  blanks ", "\u00a0nbsp\u2003em", prose(3000)]
    return made + [prose(rng.randint(1, 40)) for _ in range(40)] + [made[-1], made[9]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i not in (5, 6) else None, t, "clash", 1) for i, t in enumerate(odd_texts())] + [(20, "a repeated id", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, block int").repartition(4).cache()


def brute_alignment(rows):
    """What each text's row should hold, from the libraries' own encodings of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    of_char = crosswalk.byte_characters()
    a_bytes = lambda i: bytes(of_char[c] for c in first.id_to_token(i))
    b_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], Counter()
    for i, t in rows:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = [np.cumsum([len(f(x)) for x in ids]).tolist() for ids, f in ((a, a_bytes), (b, b_bytes))]
        groups, i_a, i_b = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            j_a, j_b = ends[0].index(end, i_a) + 1, ends[1].index(end, i_b) + 1
            groups.append((a[i_a:j_a], b[i_b:j_b]))
            i_a, i_b = j_a, j_b
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        held.update(links.keys())
        found.append((i, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block, chars, remembered", [(1 << 18, 400_000, 60_000), (50, 200, 20)])
def test_alignment_equals_brute_force(docs, monkeypatch, block, chars, remembered):
    for name, value in (("BLOCK", block), ("BATCH_CHARS", chars), ("REMEMBERED", remembered), ("WIDE", 64 if block > 50 else 2)):
        monkeypatch.setattr(crosswalk, name, value)
    want = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    if block == 50:  # in the workers the constants are the module's own; here the pieces of one text are looked at
        aligner = crosswalk.Aligner(crosswalk.Pair.of(A, B))
        al = aligner.align([r.text for r in docs.collect()])
        links = Counter()
        for _, _, text, pairs, many in aligner.links(al):
            for t, p, n in zip(text.tolist(), pairs.tolist(), many.tolist()):
                assert (t, p) not in links
                links[t, p] = n
        assert [sum(n for (t, _), n in links.items() if t == k) for k in range(len(want))] == [w[4] for w in want]
        assert aligner.digests(al) == [w[7] for w in want]
        return
    got = [tuple(r[c] for c in NAMES) for r in crosswalk.report(docs, A, B).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_gives_tokens_and_cuts(docs):
    for r in crosswalk.aligned(docs, A, B).collect():
        assert len(r.a_ends) == len(r.b_ends) and (not r.a_ends or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids)))
    assert crosswalk.report(docs.limit(0), A, B).count() == 0


def test_rank_one_updates_and_joins():
    rng = np.random.default_rng(0)
    for length, n in ((1, 5), (6, 3), (12, 200)):
        x = whitening.grid(rng.normal(size=(n, length)) * np.linspace(1, 4, length))
        x[n // 2 :] = x[: n - n // 2] if n % 2 == 0 else x[n // 2 :]  # repeated rows and equal eigenvalues
        a, b = whitening.Spectrum.empty(length), whitening.Spectrum.empty(length)
        for one in x[: n // 3]:
            a.add(one, 1)
        for one in x[n // 3 :]:
            b.add(one, 2)
        if n // 3:
            a.join(b)
            every = np.concatenate([x[: n // 3], x[n // 3 :], x[n // 3 :]])
        else:
            a, every = b, np.concatenate([x, x])
        centred = every - every.mean(axis=0)
        scatter = centred.T @ centred
        assert a.n == len(every) and a.sums == every.sum(axis=0).tolist()
        assert np.allclose(a.vectors * a.values @ a.vectors.T, scatter, atol=1e-9 * max(1.0, np.abs(scatter).max()))
        assert np.allclose(a.vectors.T @ a.vectors, np.eye(length), atol=1e-12)


def test_secular_roots_near_poles():
    rng = np.random.default_rng(4)
    for _ in range(30):
        k = int(rng.integers(1, 20))
        d = np.cumsum(10.0 ** rng.uniform(-8, 6, k))
        z = 10.0 ** rng.uniform(-5, 0, k) * rng.choice([-1, 1], k)
        z /= np.sqrt(z @ z)
        rho = 10.0 ** rng.uniform(-3, 6)
        roots = d - np.diagonal(whitening.secular_roots(d, z, rho))
        want = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z))
        assert np.allclose(np.sort(roots), want, rtol=1e-10, atol=1e-12 * max(d[-1], rho))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 12)) * np.linspace(0.2, 1, 12)).astype(np.float32)
    data[50:150] = data[7]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(data)] + [(None, data[3].tolist(), "x"), (5, data[5].tolist(), "x"), (900, None, ""), (901, [float("nan")] * 12, ""), (902, [1.0] * 11 + [None], ""), (903, [], ""), (904, [1.0, 2.0], ""), (905, [3.0, 2.5], "")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(37)).toPandas()
    x = np.floor(1024 * np.concatenate([data, data[[3, 5]]]).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    wide = got[got["n"] == n]
    assert len(wide) == 8 * n and len(got) == 8 * n + 2 * 2 and not set(got["vec_id"]) & {900, 901, 902, 903}
    deviation = {i: int(((n * v.astype(object) - sums) ** 2).sum()) for i, v in enumerate(x[:300])}
    own = wide[wide["vec_id"].notna()]
    assert all(deviation[int(i)] == d for i, d in zip(own["vec_id"], own["deviation"]))
    for k in range(8):
        part = own[own["component"] == k + 1].drop_duplicates("vec_id").sort_values("vec_id")["whitened"].to_numpy()
        sign = np.sign(part[np.abs(part).argmax()] * want[np.abs(part).argmax(), k])
        assert np.allclose(part * sign, want[:300, k], atol=1e-9)
    assert np.allclose(wide.groupby("component")["explained"].first(), values[:8] / values.sum()) and wide["identity_error"].max() < 1e-9
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0 and whitening.whitened(spark.createDataFrame(rows[303:306], "vec_id long, embedding array<float>, c string")).count() == 0


def corpus(spark):
    rng = random.Random(6)
    pairs = {"red": "apple", "blue": "sky", "green": "grass", "old": "stone"}
    rows = []
    for i in range(900):
        words = []
        for _ in range(rng.randint(5, 40)):
            k = rng.choice(list(pairs))
            words += [k, pairs[k]]
        rows.append((i, " ".join(words) + (" Once%d" % i if i % 9 == 0 else "")))
    rows += [(2000, None), (2001, ""), (None, "RED Apple É"), (3, "red apple"), (2002, "\t zzz\n\x0bzzz "), (2003, "red apple " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scores_equal_the_base_and_beat_it(spark):
    docs = corpus(spark).repartition(3).cache()
    own = [(r.doc_id, r.text or "", r.out) for r in docs.select("doc_id", "text", (remainder(docs["doc_id"], 7) == 2).alias("out")).collect()]
    words = lambda t: t.encode().lower().split() + [b""]
    counts = Counter(w for _, t, out in own if not out for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t, out in own)
    got = recurrent.scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > 0.9 * sum(r.base_score for r in got if r.held_out)
    assert recurrent.scores(docs.limit(0)).count() == 0
    held = docs.filter(remainder(docs["doc_id"], 7) == 2)
    assert all(r.score == r.base_score and r.train_tokens == 0 for r in recurrent.scores(held).collect())


def test_probabilities_add_up_and_start_at_the_base():
    counts = recurrent.Counts(100, 70, tuple([9, 8, 7] + [1] * 37))
    net = recurrent.Network.start(counts)
    states = np.random.default_rng(1).uniform(-1, 1, (5, recurrent.HIDDEN)).astype(np.float32)
    log = np.stack([net.likelihoods(states, np.full(5, k))[0] for k in [*range(40), net.outputs]])
    assert np.allclose(np.exp(log).sum(axis=0), 1, atol=1e-5)
    assert np.allclose(np.exp(log[0]), 10 / counts.whole, atol=1e-6) and np.allclose(np.exp(log[-1]), counts.rest / counts.whole, atol=1e-6)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = recurrent.Network.start(recurrent.Counts(3000, 90, tuple(range(60, 0, -1))))
    for part in net.parts.values():
        part[...] += 0.2 * rng.normal(size=part.shape).astype(np.float32) * (np.abs(part) < 1e8)
    net = recurrent.Network({k: v.astype(np.float64) for k, v in net.parts.items()}, net.past)
    inputs, targets = rng.integers(0, 60, (6, 5)), rng.integers(0, 60, (6, 5))
    targets[4:, 2] = -1
    targets[2, 1] = net.outputs
    fresh = np.zeros((6, 5), dtype=bool)
    fresh[0], fresh[3, 4] = True, True

    def loss():
        states, _ = net.forward(np.zeros((5, recurrent.HIDDEN)), inputs, fresh, False)
        used = targets >= 0
        return -float(net.likelihoods(states[used], targets[used])[0].astype(np.float64).sum())

    before = {k: v.copy() for k, v in net.parts.items()}
    trial = recurrent.Network({k: v.copy() for k, v in net.parts.items()}, {k: np.full_like(v, 1e12) for k, v in net.past.items()})
    trial.learn(np.zeros((5, recurrent.HIDDEN)), inputs, targets, fresh, 1.0)
    for name in ("inputs", "turn", "shift", "classes", "words"):
        step = (before[name] - trial.parts[name]) * 1e6  # the slope, as the squared steps so far are fixed
        for at in zip(*np.unravel_index(np.argsort(-np.abs(step), axis=None)[:3], step.shape)):
            net.parts[name][at] = before[name][at] + 0.02
            up = loss()
            net.parts[name][at] = before[name][at] - 0.02
            down = loss()
            net.parts[name][at] = before[name][at]
            assert step[at] == pytest.approx((up - down) / 0.04, rel=0.05, abs=0.02), name


def test_windows_hold_every_document_in_order():
    rng = np.random.default_rng(3)
    docs = [(k, rng.integers(1, 50, rng.integers(1, 200)).astype(np.uint16)) for k in range(70)]
    seen = defaultdict(list)
    lanes = 8
    for inputs, targets, fresh, keys, going in recurrent.windows(iter(docs), 8, 0):
        assert len(going) <= lanes and inputs.shape == (recurrent.STEPS, len(going))
        lanes = len(going)
        for lane in range(lanes):
            for i, t, f, k in zip(inputs[:, lane], targets[:, lane], fresh[:, lane], keys[:, lane]):
                if t >= 0:
                    assert f == (not seen[k]) and i == (seen[k][-1] if seen[k] else 0)
                    seen[k].append(t)
    assert all(seen[k] == ids.tolist() for k, ids in docs) and len(seen) == 70


def test_documents_leave_once_and_whole():
    rng = np.random.default_rng(9)
    net = recurrent.Network.start(recurrent.Counts(3000, 90, tuple(range(60, 0, -1))))
    for part in net.parts.values():
        part[...] += 0.2 * rng.normal(size=part.shape).astype(np.float32) * (np.abs(part) < 1e8)
    ids = [rng.integers(0, 61, rng.integers(1, 400)).astype(np.uint16) for _ in range(300)]
    names = ["doc_id", "held", "length", "known", "base", "rest", "ids"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, (i, False, len(x), 0, 0.0, 0.5, x.tobytes()))) for i, x in enumerate(ids)][k : k + 70]) for k in range(0, 300, 70)]
    several = {r["doc_id"]: r["score"] for b in recurrent.scored_batches(iter(batches), net, 10) for r in b.to_pylist()}
    assert sum(len(b) for b in recurrent.scored_batches(iter(batches), net, 10)) == 300
    for i in (0, 17, 299):
        alone = next(recurrent.scored_batches(iter([batches[i // 70].slice(i % 70, 1)]), net)).to_pylist()[0]["score"]
        assert several[i] == pytest.approx(alone, rel=1e-4)
