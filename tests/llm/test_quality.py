"""The byte network: cover, gradients, held-out accuracy and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from feedlake.llm import quality as q


@pytest.mark.parametrize("size", [0, 1, 64, 255, 256, 257, 448, 449, 5000])
def test_chunks_cover_the_text(size):
    data = bytes(1 + i % 250 for i in range(size))
    data = "".join(chr(32 + b % 90) for b in data)
    parts = q.chunks(data)
    whole = b"".join(p[: q.CHUNK_STEP].tobytes() for p in parts[:-1]) + parts[-1].tobytes()
    assert whole.rstrip(b"\0") == data.encode()
    assert len(whole) - len(data) < q.CHUNK + 1
    assert not np.any(np.frombuffer(whole[size:], np.uint8))


def test_blocks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (0, 10, 300, 90_000, 40, 2_000)] + [None]
    w = q.initial()
    w["out"][:] = rng.normal(size=2 * q.HIDDEN)
    whole = q.score(w, texts)
    monkeypatch.setattr(q, "BLOCK", 7)
    assert np.allclose(whole, q.score(w, texts), atol=1e-5)
    assert np.allclose(whole, [q.score(w, [t])[0] for t in texts], atol=1e-5)
    assert np.isclose(whole[0], whole[-1], atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    w = {k: v.astype(np.float64) for k, v in q.initial().items()}
    w["out"][:] = rng.normal(size=2 * q.HIDDEN)
    parts = [q.chunks("".join(map(chr, rng.integers(32, 127, n)))) for n in (30, 700, 1500)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for part, y in zip(parts, labels, strict=True):
            described = q._describe(w, part)
            p = q._sigmoid(np.hstack([described.max(axis=0), described.mean(axis=0)]) @ w["out"] + w["out_bias"][0])
            total -= y * np.log(p) + (1 - y) * np.log(1 - p)
        return total / len(parts)

    found = q.gradients(w, parts, labels)
    for name, values in w.items():
        flat = values.reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            kept, flat_step = flat[i], 1e-6
            flat[i] = kept + flat_step
            up = loss()
            flat[i] = kept - flat_step
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * flat_step) - found[name].reshape(-1)[i]) < 1e-4, name


def test_held_out_accuracy(spark):
    from feedlake.llm.queries import op1_quality

    sf = "/root/testdata/sf0.01"
    got = op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = [[r.score for r in held if r.quality == y] for y in (1, 0)]
    ranked = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert ranked > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "fine words. " * 30, "a", 0.5), (2, "", "a", None), (3, None, None, 1.0), (1, "fine words. " * 30, "a", 0.5),
         (None, "no id", "b", 2.0), (4, "%% " * 200_000, "b", 2.0)],
        "doc_id long, text string, quality string, score double",
    )
    labels = spark.createDataFrame(
        [(1, 1, 0), (4, 0, 0), (2, None, 0), (None, 1, 0), (9, 1, 0), (3, 7, 1)], "doc_id long, quality int, text int"
    )
    w = q.fit(docs, labels)
    scores = docs.select("doc_id", q.scorer(w, docs.text).alias("s")).collect()
    assert len(scores) == 6
    assert all(0 <= r.s <= 1 for r in scores)
    assert len({round(r.s, 5) for r in scores if r.doc_id in (2, 3)}) == 1
    kept = q.keep_good(docs, w, 0.0)
    assert kept.columns == docs.columns
    assert kept.count() == 6
    assert q.keep_good(docs.where("false"), w).count() == 0
    untrained = q.fit(docs, labels.where("false"))
    assert [r.s for r in docs.select(q.scorer(untrained, docs.text).alias("s")).collect()] == pytest.approx([0.5] * 6)


def test_training_texts_are_whole(spark, monkeypatch):
    texts = {i: f"{i} " * 2_000 + f"middle{i} " + "tail " * 3_000 for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    got, _ = q.training_rows(docs, labels)
    assert sorted(got) == sorted(texts.values())
    monkeypatch.setattr(q, "TRAIN_BYTES", 100_000)
    fewer, marks = q.training_rows(docs, labels)
    assert set(fewer) < set(got) and len(fewer) == len(marks)
    assert 100_000 <= sum(map(len, fewer)) < 100_000 + max(map(len, got))


def test_blocks_do_not_change_gradients(monkeypatch):
    rng = np.random.default_rng(6)
    w = {k: v.astype(np.float64) for k, v in q.initial().items()}
    w["out"][:] = rng.normal(size=2 * q.HIDDEN)
    parts = [q.chunks("".join(map(chr, rng.integers(32, 127, n)))) for n in (30, 70_000, 9_000)]
    labels = np.array([1.0, 0.0, 1.0])
    whole = q.gradients(w, parts, labels)
    monkeypatch.setattr(q, "BLOCK", 7)
    for name, values in q.gradients(w, parts, labels).items():
        assert np.allclose(values, whole[name], atol=1e-6), name
