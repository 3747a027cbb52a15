"""Substring dedup, decontamination, token counts and the text kernel."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lithospark.llm import parts
from lithospark.llm import substring_dedup as sd
from lithospark.llm import textkernel as tk
from lithospark.llm import token_counts as counting
from lithospark.llm.decontaminate import decontaminate, merged
from lithospark.llm.substring_dedup import substring_dedup
from lithospark.llm.textkernel import pieces, space_words
from lithospark.llm.token_counts import count_huge, token_counts
from tests.llm import brute


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(50)] + ["Ünï", "ß,"]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 35, 60)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.2:
            words += ["same"] * rng.randint(1, 60)
        rows.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "x" * 100_000), (505, "a b c d " * 8000), (-7, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = passages(seed)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.substring(rows)
    for r in got:
        assert sum(s.end_word - s.first_word for s in r.repeats) == r.n_removed


def test_substring_dedup_edges(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"v{k}" for k in range(30))
    df = spark.createDataFrame([(4, long, 1, "a"), (4, long, 2, "b"), (None, long, 3, "c"), (9, "q", 4, None)], "doc_id long, text string, n_words int, kept_text string")
    got = {(r.doc_id, r.n_removed, r.n_words) for r in substring_dedup(df).collect()}
    assert got == {(4, 0, 30), (None, 30, 30), (9, 0, 1)}  # equal rows are one document; a null key comes last
    odd = spark.createDataFrame([(1, long, 5, 6, 7)], "doc_id long, text string, _order int, _bucket int, removed int")
    assert substring_dedup(odd).select("_order", "_bucket", "removed", "n_words").first() == (5, 6, 7, 30)


@pytest.mark.parametrize("window", [13, 4])
def test_decontamination_equals_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    vocabulary = [f"v{k}" for k in range(12)] + ["É", "x9"]
    items = [(k, rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for k in range(25)] + [(None, "v1 v2 v3"), (3, "v1 v1 v1 v1"), (77, None), (78, "...")]
    docs = [(k, " ".join(rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 80))) + " " + rng.choice(items)[1].__str__()) for k in range(40)] + [(100, None), (101, ""), (102, "v0 " * 30_000), (103, "y" * 70_000), (7, "v1")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(docs, items, window), key=repr)
    got = decontaminate(df, bench, window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == want
    # In several passes the result is the same.
    import lithospark.llm.decontaminate as module

    monkeypatch.setattr(module, "PASS_BYTES", 100)
    passes = decontaminate(df, bench, window=window).collect()
    assert sorted((tuple(r) for r in passes), key=repr) == sorted((tuple(r) for r in got), key=repr)


def test_decontamination_edges(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).select("n_words", "n_hit").first() == (2, 0)
    assert decontaminate(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, "a b", 9, "k")], "doc_id long, text string, n_hit int, items string")
    assert decontaminate(odd, none).select("doc_id", "n_hit", "items").first() == (1, 0, [])
    assert merged([{"first_word": 5, "end_word": 9}, {"first_word": 1, "end_word": 5}, {"first_word": 20, "end_word": 21}]) == [{"first_word": 1, "end_word": 9}, {"first_word": 20, "end_word": 21}]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize(("step", "overlap"), [(50, 4), (97, 20), (1000, 64)])
def test_chunks_count_as_the_whole(step, overlap):
    _, t = tokenizer()
    rng = random.Random(step)
    pieces = [*"ab '\n\t1.é字<|>", "<|endoftext|>", "'re", "   ", "endoftext", "word "]
    cases = ["", "a" * 5000, " " * 4000 + "x", "<|endoftext|>" * 300, ("ab'll  \n\n" + " " * 40) * 200, "é " * 3000, "1234 " * 900 + "　 " * 400 + "字" * 2000]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 500))) for _ in range(120)]
    for text in cases:
        assert count_huge(t, text, step, overlap) == len(t.encode(text, add_special_tokens=False).ids), repr(text[:40])


def test_token_counts(spark):
    path, t = tokenizer()
    texts = ["plain words", None, "", "ü<|endoftext|>x", "long text here " * 9000, "plain words", "z" * 70_000]
    df = spark.createDataFrame([(k, x, "e") for k, x in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(df, path, huge=1000).collect()}
    assert got == {k: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts)}
    assert token_counts(df.limit(0), path).count() == 0


class Spy:
    """A tokenizer that notes how many characters it is given."""

    def __init__(self, real):
        self.real, self.given = real, 0

    def encode(self, text, **options):
        self.given += len(text)
        return self.real.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.real.encode_batch_fast(texts, **options)

    def get_added_tokens_decoder(self):
        return self.real.get_added_tokens_decoder()


def test_pieces_that_come_again_are_encoded_once(monkeypatch):
    path, t = tokenizer()
    spy = Spy(t)
    monkeypatch.setattr("tokenizers.Tokenizer", SimpleNamespace(from_str=lambda rules: spy))
    monkeypatch.setattr(counting, "_counters", {})
    texts = ["one word, another word.\nA line of its own " * 5000, "another word, one line.\nA word " * 20, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    with open(path, encoding="utf-8") as file:
        run = counting._count(SimpleNamespace(value=file.read()), "text", counting.HUGE, True)
    got = [n for b in run([batch]) for n in b.column("n_tokens").to_pylist()]
    assert got == [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    assert spy.given < 1000


@pytest.mark.parametrize("block", [40, 700, 1 << 20])
def test_pieces_count_as_the_whole(monkeypatch, block):
    monkeypatch.setattr(counting, "BATCH_BYTES", block)
    monkeypatch.setattr(counting, "KNOWN", 500)
    _, t = tokenizer()
    rng = random.Random(block)
    pieces = [*"abZ79éàÿ×÷字–ñ٣²", *" \n\t\r\x0b\x0c\x1c\x1f\x00\x7f\x85\xa0\u1680\u180e\u2000\u2008\u2009\u200a\u200b\u2028\u202f\u205f\u3000\ufeff", *"  \n\n'.,<|>_-", "<|endoftext|>", "'re", " 's", "\n'll", "word", " word. ", "x" * 30]
    texts = ["", "a", " ", "\n", "a ", " a", "a\n", "\na", "a \n b", "à b", "é. A", "b\n\nc", "<|endoftext|>.", "a.<|endoftext|> x", "z" * 3000, " " * 500 + "b"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces[:30]) + a + rng.choice(pieces[:30]) for a in " \n.") for _ in range(3000)]
    data, offsets = tk.text_buffer(pa.array(texts))
    got = counting.PieceCounts(t).count(data, offsets, 50).tolist()
    assert got == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_kernel_splits_like_the_patterns():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aB9 \t\n\x0b.,-é字\x00\x7f") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for words, pattern, fold in ((tk.space_words(False), brute.SPACED, False), (tk.alnum_words(True), brute.ALNUM, True)):
        data, offsets = tk.text_buffer(pa.array(texts))
        starts, ends, first = words.split(data, offsets)
        hashes = words.hashes(data, starts, ends)
        seen = {}
        for k, text in enumerate(texts):
            want = pattern.findall(brute.lower(text) if fold else text)
            spans = [bytes(data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            assert [brute.lower(s) if fold else s for s in spans] == want
            for w, h in zip(want, hashes[first[k] : first[k + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_kernel_blocks(monkeypatch):
    words = tk.space_words(False)
    text = "ab " * 1000 + "x" * 500 + " yz"
    data, offsets = tk.text_buffer(pa.array([text, None, text]))
    starts, ends, first = words.split(data, offsets)
    whole = words.hashes(data, starts, ends)
    monkeypatch.setattr(tk, "BLOCK", 64)
    assert (words.hashes(data, starts, ends) == whole).all() and list(np.diff(first)) == [1002, 0, 1002]


def test_pieces_cover_every_run_once():
    rng = random.Random(4)
    texts = ["", "a b", " ".join("w" * rng.randint(1, 30) for _ in range(400)), "x" * 700, None, "  y  ", " ".join(["z" * 300] * 9) + " ", " " * 900]
    column, words = pa.array(texts, pa.string()), space_words(fold=False)
    for overlap in (0, 3, 19):
        for limit in (64, 200, 5000):
            seen = {t: [] for t in range(len(texts))}
            for piece in pieces(words, column, overlap, limit):
                for t in range(piece.begin, piece.end):
                    a, b = piece.first[t - piece.begin : t - piece.begin + 2]
                    own = [bytes(piece.data[x:y]).decode() for x, y in zip(piece.starts[a:b], piece.ends[a:b], strict=True)]
                    seen[t] += [(piece.base + k, tuple(own[k : k + overlap + 1])) for k in range(len(own) - overlap)]
            for t, text in enumerate(texts):
                own = (text or "").split()
                assert seen[t] == [(k, tuple(own[k : k + overlap + 1])) for k in range(len(own) - overlap)]


def test_substring_dedup_of_long_texts(spark):
    rng = random.Random(6)
    word = lambda: f"{rng.randrange(10**9):09d}" * 8
    passage = [word() for _ in range(70)]
    long = [word() for _ in range(130_000)]  # some 9 MB, three pieces
    for at in (5, 40_000, 57_460, 90_000, 129_900):
        long[at : at + 70] = passage
    rows = [(1, " ".join(passage[:45])), (2, " ".join(long)), (3, " ".join(passage)), (4, "  ".join(long[57_000:60_000]))]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.substring(rows)
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == want
    for i, text in rows:
        spans = [(s.first_word, s.end_word) for s in got[i].repeats]
        assert sum(b - a for a, b in spans) == want[i][1] and all(y < a for (_, y), (a, _) in zip(spans, spans[1:]))
        gone = {k for a, b in spans for k in range(a, b)}
        assert " ".join(w for k, w in enumerate(text.split()) if k not in gone) == want[i][2]


def test_substring_dedup_sends_a_third_at_once(spark, monkeypatch):
    monkeypatch.setattr("lithospark.llm.parts.PART_TOKENS", 64)
    rng, sent = random.Random(3), []

    def counted(step):
        def spy(*args):
            run, total = step(*args), spark.sparkContext.accumulator(0)
            sent.append(total)

            def counting(batches):
                for batch in run(batches):
                    total.add(sum(len(x) for c in batch.columns if pa.types.is_binary(c.type) for x in c.to_pylist()))
                    yield batch

            return counting

        return spy

    monkeypatch.setattr(sd, "_offer", counted(sd._offer))
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([15, 150, 400])))) for k in range(60)]
    rows += [(100 + k, " ".join([*(f"v{k}x{i}" for i in range(k)), *x.split()[5:60], "end"])) for k, (_, x) in enumerate(rows)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.substring(rows)
    blocks = sum(max(0, len(x.split()) - 9) for _, x in rows)
    assert len(sent) > 1 and max(x.value for x in sent) <= 4 * blocks  # 4 bytes a hash and some for its owner, of a third


def test_substring_dedup_in_passes_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("lithospark.llm.parts.PART_TOKENS", 64)
    rows = passages(4)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.substring(rows)


def test_places_go_as_steps():
    rng = np.random.default_rng(2)
    each = [np.sort(rng.integers(0, top, n)) for top, n in [(3, 50), (5000, 40), (1, 0), (2**24, 9), (2**24, 1), (1, 4)]]
    rows = pd.DataFrame([parts.steps(x) for x in each], columns=["low", "high"])
    assert parts.places(rows).tolist() == np.concatenate(each).tolist()
    assert [len(x) for x in rows.high][::5] == [0, 0]


def test_substring_dedup_of_repeated_rows_and_keys(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text)] * 40 + [(None, text + " end")] * 40 + [(7, "other " + text)] * 3 + [(8, text)]
    got = {}
    for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect():
        got.setdefault((r.doc_id, r.n_words), set()).add(r.kept_text)
    assert got[8, 50] == {""} and got[None, 51] == {"end"}
    assert sorted([got[7, 50], got[7, 51]], key=repr) in ([{text}, {"other"}], [{""}, {"other " + text}])
