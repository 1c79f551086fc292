from __future__ import annotations

import random

import numpy as np

from nightspark.llm import scoring

SHAPE = scoring.Shape(buckets=512, batch=256, rounds=3)


def sentences(rng, n):
    """A toy language: each word is fixed by its left and right neighbours' classes."""
    a, b, c = (["%s%d" % (x, i) for i in range(20)] for x in "abc")
    return [" ".join(w for _ in range(30) for w in (rng.choice(a), rng.choice(b), rng.choice(c))) for _ in range(n)]


def test_held_out_order_is_told_from_disorder(spark, documents, edge_rows):
    rng = random.Random(11)
    model = scoring.fit(documents(list(enumerate(sentences(rng, 300)))).repartition(3), shape=SHAPE)
    held = sentences(rng, 40)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    out = scoring.score(documents([*enumerate(held), *enumerate(mixed, 100), *edge_rows]), model).collect()
    assert len(out) == 80 + len(edge_rows)
    by = {r.doc_id: r.per_word for r in out}
    good = np.array([r.per_word for r in out[:0]] + [r.per_word for r in out if r.doc_id is not None and 10 <= r.doc_id < 40])
    bad = np.array([by[110 + i] for i in range(30)])
    assert (good > bad + 0.3).mean() > 0.9 and abs(good.mean() - np.log(1 / 20)) < 0.6
    assert {(r.n_words, r.log_likelihood, r.per_word) for r in out if r.n_words == 0} == {(0, 0.0, None)}
    assert scoring.score(documents([]), model).collect() == []
    empty = scoring.fit(documents([]), shape=scoring.Shape(buckets=16, rounds=1))
    assert len(scoring.score(documents([(1, "a b")]), empty).collect()) == 1


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 50, SHAPE.buckets).astype(float)
    classes = scoring.equal_mass_classes(counts, SHAPE.classes)
    mass = np.bincount(classes, counts + 1, SHAPE.classes)
    share = (counts + 1) / mass[classes]
    out = scoring.forward(SHAPE.split(SHAPE.start()), np.random.default_rng(2).integers(0, SHAPE.buckets, (5, 4)))[2]
    assert np.allclose((np.exp(out)[:, classes] * share).sum(axis=1), 1, atol=1e-4)


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(4)
    context, target = rng.integers(0, SHAPE.buckets, (256, 4)), rng.integers(0, SHAPE.classes, 256)
    trainer = scoring.Trainer(SHAPE, SHAPE.start(), np.zeros(SHAPE.buckets + 1, np.int64))
    loss = lambda: -scoring.forward(trainer.parts, context)[2][np.arange(256), target].mean()
    before = loss()
    for _ in range(40):
        trainer._step(context, target)
    assert loss() < before - 0.5
