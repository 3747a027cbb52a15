"""Operators that SQL can't express against plain versions: trees, quotation linking, the shuffle."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lithospark.llm import feistel_shards, quality
from lithospark.llm.quotes import link_quotes
from lithospark.llm.textkernel import text_buffer


def plain_fit(x, y, trees):
    """Boosted trees with plain loops over nodes, features and cuts: a list of (feature, threshold, leaf) triples and the start."""
    n, width = x.shape
    share = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    raw = [math.log(share / (1 - share))] * n
    cuts = [sorted({float(np.quantile(x[:, f], q, method="lower")) for q in np.linspace(0, 1, quality.BINS + 1)[1:-1]}) for f in range(width)]
    inner, made = 2**quality.DEPTH - 1, []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        feature, threshold, node = [0] * inner, [math.inf] * inner, [0] * n
        for depth in range(quality.DEPTH):
            for at in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows = [i for i in range(n) if node[i] == at]
                best = 1e-6
                for f in range(width):
                    gains = []
                    for c in cuts[f]:
                        left = [i for i in rows if x[i, f] <= np.float32(c)]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                        gains.append(0 if hl < 0.5 or ht - hl < 0.5 else gl**2 / (hl + quality.LAMBDA) + (gt - gl) ** 2 / (ht - hl + quality.LAMBDA) - gt**2 / (ht + quality.LAMBDA))
                    k = max(range(len(gains)), key=lambda k: (gains[k], -k)) if gains else None
                    if k is not None and gains[k] > best + 1e-9:
                        best, feature[at], threshold[at] = gains[k], f, cuts[f][k]
            node = [2 * v + 1 + (x[i, feature[v]] > threshold[v]) if v < 2 ** (depth + 1) - 1 else v for i, v in enumerate(node)]
        leaf = []
        for v in range(inner, 2 * inner + 1):
            rows = [i for i in range(n) if node[i] == v]
            leaf.append(-quality.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.LAMBDA))
        raw = [r + leaf[v - inner] for r, v in zip(raw, node, strict=True)]
        made.append((feature, threshold, leaf))
    return made, raw


def test_trees_equal_a_plain_fit(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 3)
    monkeypatch.setattr(quality, "DEPTH", 3)
    monkeypatch.setattr(quality, "BINS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4)).astype(np.float32).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] * x[:, 1] > 0.1)).astype(float)
    fitted = quality.fit(x, y)
    made, raw = plain_fit(x, y, 3)
    for t, (feature, threshold, leaf) in enumerate(made):
        assert fitted.feature[t].tolist() == feature
        assert np.allclose(fitted.threshold[t], threshold) and np.allclose(fitted.leaf[t], leaf)
    # The flattened traversal against one comparison after another, on unseen rows too.
    new = np.concatenate([x, rng.normal(size=(50, 4)).astype(np.float32)])
    for row, score in zip(new, fitted.score(new), strict=True):
        total = fitted.base
        for feature, threshold, leaf in made:
            at = 0
            while at < 7:
                at = 2 * at + 1 + bool(row[feature[at]] > np.float32(threshold[at]))
            total += leaf[at - 7]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    assert np.allclose(1 / (1 + np.exp(-np.array(raw))), fitted.score(x))


def plain_statistics(text):
    body = text.encode()
    words = body.split()
    if not body:
        return [0.0] * len(quality.FEATURES)
    kind = {b: k for k, c in enumerate(quality._CLASSES.values()) for b in c}
    shares = Counter(kind.get(b, len(quality._CLASSES)) for b in body)
    n = max(1, len(words))
    count = Counter(words)
    lines = [x for x in (line.split() for line in body.split(b"\n")) if x]
    ends = Counter(kind.get(w[-1], len(quality._CLASSES)) for w in words)
    return [
        math.log1p(len(body)), math.log1p(len(words)), *(shares[k] / len(body) for k in range(len(quality._CLASSES) + 1)), sum(map(len, words)) / n, len(count) / n, max(count.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, sum(65 <= w[0] <= 90 for w in words) / n, sum(len(w) == 1 for w in words) / n, sum(len(w) > 24 for w in words) / n,
        sum(ends[k] for k in range(5, 9)) / n, len(words) / max(1, len(lines)), len({tuple(x) for x in lines}) / max(1, len(lines)),
    ]


def test_statistics_equal_plain_ones():
    import pyarrow as pa

    rng = random.Random(2)
    parts = ["The", "house", "a", "a", "!!", "x|y", "12.5", "\n", "\n\n", "é", "ß,", "(b)", "w" * 30, "end.", "\t", "so;", "#1"]
    texts = ["", " ", "one", "\n", "a\na\nb", *(rng.choice([" ", "  "]).join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(200))]
    got = quality.statistics(*text_buffer(pa.array(texts)))
    want = np.array([plain_statistics(t) for t in texts], np.float32)
    assert np.allclose(got, want, atol=1e-6), [(quality.FEATURES[f], texts[t]) for t, f in np.argwhere(~np.isclose(got, want, atol=1e-6))[:5]]


def plain_links(messages):
    """{(conv, turn): (parent, root, depth, n_passages, n_linked)} with dictionaries, message by message."""
    import re

    units = defaultdict(dict)  # message -> {(level, text): words}
    for c, t, text in messages:
        level, block = 0, []

        def put(level, block):
            for unit in {" ".join(" ".join(block).lower().split()), *(" ".join(x.lower().split()) for x in block)}:
                if unit:
                    units[c, t][level, unit] = len(unit.split())  # noqa: B023

        for line in (text or "").splitlines():
            m = re.match(r"\s{0,3}((?:>\s?)+)", line)
            now, line = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if block and (now != level or not line.strip()):
                put(level, block)
                block = []
            if line.strip():
                level = now
                block.append(line)
        if block:
            put(level, block)
    first = {}
    for c, t, _ in sorted(messages, key=lambda m: m[:2]):
        for level, unit in units[c, t]:
            if level == 0:
                first.setdefault((c, unit), t)
    parent, told = {}, {}
    for c, t, _ in messages:
        by = defaultdict(lambda: defaultdict(int))
        quoted = [(level, unit, n) for (level, unit), n in units[c, t].items() if level]
        linked = 0
        for level, unit, n in quoted:
            origin = first.get((c, unit))
            if origin is not None and origin < t:
                by[level][origin] += n
                linked += 1
        if by:
            own = by[min(by)]
            parent[c, t] = max(own, key=lambda o: (own[o], o))
        told[c, t] = (len(quoted), linked)
    out = {}
    for c, t, _ in messages:
        root, depth = t, 0
        while (c, root) in parent:
            root, depth = parent[c, root], depth + 1
        out[c, t] = (parent.get((c, t)), root, depth, *told[c, t])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    messages = []
    for c in range(12):
        earlier = []
        for t in range(rng.randint(1, 14)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if earlier and rng.random() < 0.7:
                    level = rng.randint(1, 3)
                    quoted = rng.choice(earlier).splitlines() or [""]
                    lines += ["On that day X wrote:"] * (rng.random() < 0.3) + [rng.choice(["> ", ">"]) * level + x.upper() for x in quoted[: rng.randint(1, 4)]] + [""] * rng.randint(0, 1)
                lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 3))] + [""]
            text = "\n".join(lines)
            earlier.append(text)
            messages.append((c, t * 2, text))
    df = spark.createDataFrame(messages, "conv_id long, turn long, text string").repartition(3)
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    want = plain_links(messages)
    assert {k: (r.parent_turn, r.root_turn, r.depth, r.n_passages, r.n_linked) for k, r in got.items()} == want
    assert sum(v[0] is not None for v in want.values()) > 20
    for c in range(12):
        order = [t for _, t in sorted((want[k][1], k[1]) for k in want if k[0] == c)]
        assert [t for _, t in sorted((got[c, t].position, t) for t in order)] == order


def hashed(*values):
    """What xxhash64() gives for longs (int), ints (a pair), and text."""
    seed = 42
    for v in values:
        body = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True) if isinstance(v, int) else int(v[0]).to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(body, seed)
    return seed - 2**64 if seed >= 2**63 else seed


@pytest.mark.parametrize(("n", "shards"), [(1, 8), (7, 3), (500, 8), (530, 8)])
def test_shuffle_equals_plain_rounds(spark, n, shards):
    rng = random.Random(n)
    rows = [(k, rng.choice(["x", "é y", "zz" * 9])) for k in range(n - n // 5)]
    rows += [rng.choice(rows) for _ in range(n // 5)]
    got = feistel_shards.feistel_shards(spark.createDataFrame(rows, "k long, t string").repartition(3), shards, seed=5, run=2).collect()
    # Row numbers: runs of equal rows by an unsigned hash of their content.
    runs = sorted((hashed(k, t, (i,)) % 2**64, k, t, i, min(2, c - 2 * i)) for (k, t), c in Counter(rows).items() for i in range(-(-c // 2)))
    number, numbers = 0, defaultdict(list)
    for _, k, t, _, size in runs:
        numbers[k, t] += range(number, number + size)
        number += size
    a, b = feistel_shards.halves(n)

    def once(x):
        left, right = x // b, x % b
        for r in range(feistel_shards.ROUNDS):
            if r % 2 == 0:
                left = (left + hashed(right, (r,), (5,)) % a) % a
            else:
                right = (right + hashed(left, (r,), (5,)) % b) % b
        return left * b + right

    found = defaultdict(list)
    for r in got:
        at = once(r.row_no)
        while at >= n:
            at = once(at)
        assert (r.position, r.shard, r.slot) == (at, at % shards, at // shards)
        found[r.k, r.t].append(r.row_no)
    assert {k: sorted(v) for k, v in found.items()} == dict(numbers)
    assert sorted(r.position for r in got) == list(range(n))
