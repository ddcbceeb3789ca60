"""The segment tree, the alignment and the ranked search against the libraries and brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from stackfall.llm import cross_align, impact_search, segment_bpe, text_units

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_tokens string, score int, rank string, row int, query int"
PARTS = [" ", "\n", "\t", "a", "b", "the", "'s", "é", "日本", "1", "23", ".", "!!", "\x1c", "\xa0", "\x0b", "\r\n",
         "  ", "😀", "<|endoftext|>", "<s>", "<0x41>", "　", "Word", "\x85", "\x00", "▁"]


def odd_texts(n=1500, seed=1):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(n)]
    words = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 9))) for _ in range(300)]
    texts += [" ".join(r.choice(words) + r.choice(["", ".", ",\n"]) for _ in range(60)) for _ in range(60)]
    texts += ["".join(chr(r.randrange(0x20, 0x2FFF)) for _ in range(40)) for _ in range(60)]
    return texts + ["", None, "ab" * 3000, "x" * 2000 + " y", " " * 700, "a b " * 5000]


def rows_of(texts):
    return [(i, t, "x", 1, "y", 2, 3) for i, t in enumerate(texts)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_units_keep_all_characters(size):
    for text in filter(None, odd_texts()):
        found = list(text_units.windows(text, size))
        assert "".join(found) == text
        assert ["".join(text_units.units(w)) for w in found] == found
        for window in found[1:]:
            assert window[0] in " \n"


def test_memory_forgets_only_what_was_not_met():
    made = []
    memory = text_units.Memory(lambda units: made.extend(units) or [u.upper() for u in units], 3)
    for portion in (["a", "b", "c"], ["a", "d"], ["a", "d", "e"], ["b", "L" * 100]):
        memory.learn([portion, portion[:1]])
        assert list(map(memory.get, portion)) == [u.upper() for u in portion]
    assert Counter(made)["a"] == 1 and Counter(made)["L" * 100] == 1


def test_segment_tree_takes_the_leftmost_lowest_rank():
    r = random.Random(5)
    pairs, made = [], {}
    for rank in range(60):
        a, b = r.randrange(4 + rank), r.randrange(4 + rank)
        if (a, b) not in made:
            made[a, b] = 4 + len(pairs)
            pairs.append((a, b, 4 + len(pairs)))
    merges = segment_bpe.Merges(pairs, 200)
    for _ in range(400):
        symbols = [r.randrange(4) for _ in range(r.randint(2, 33))]
        size = 1 << (len(symbols) - 2).bit_length()
        rows = np.full((2, size + 1), -1, np.int64)
        rows[:, : len(symbols)] = symbols
        segment_bpe.merge(rows, merges)
        expected = list(symbols)
        while ranks := [(pairs.index((*p, made[p])), i) for i, p in enumerate(zip(expected, expected[1:])) if p in made]:
            rank, i = min(ranks)
            expected[i : i + 2] = [pairs[rank][2]]
        assert rows[0][rows[0] >= 0].tolist() == expected == rows[1][rows[1] >= 0].tolist()
        assert segment_bpe.merge_long(symbols, merges) == expected


def test_segment_bpe_equals_the_library(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(A), odd_texts()
    rows = rows_of(texts) + [(None, "null id", "", 0, "", 0, 0), (7, texts[7], "", 0, "", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    expected = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    found = [tuple(r) for r in segment_bpe.round_trip(docs, A).collect()]
    assert Counter(found) == Counter(expected)
    both = docs.select("text", segment_bpe.encode(F.col("text"), A).alias("ids"))
    both = both.withColumn("back", segment_bpe.decode(F.col("ids"), A)).collect()
    assert all(r.back == (r.text or "") for r in both)
    assert segment_bpe.tokenizer(A).decode([162, 244]) == library.decode([162, 244])
    assert segment_bpe.round_trip(docs.limit(0), A).collect() == []


def test_segment_bpe_by_small_portions(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(text_units.portions, "__defaults__", (40,))
    monkeypatch.setattr(text_units.windows, "__defaults__", (7,))
    own, library, texts = segment_bpe.Tokenizer(A), Tokenizer.from_file(A), odd_texts(400)
    own.told.limit = own.pieces.limit = 50
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.encode(texts) == expected
    assert [d[1] for d in own.digests(texts)] == [sha(",".join(map(str, ids))) for ids in expected]


def test_plain_ascii_is_split_as_the_library_does(monkeypatch):
    own, r, asked = segment_bpe.Tokenizer(A), random.Random(3), []
    split, some = own.vocabulary.split, ["'", "s", "t", "re", " ", "  ", "l", "1", ".", "_", "-", *map(chr, range(32, 127))]
    units = ["".join(r.choice(some[: 11 if i % 2 else None]) for _ in range(r.randint(1, 9))) for i in range(4000)]
    own.vocabulary.split = lambda unit: asked.append(unit) or split(unit)
    own.told.learn([units])
    assert asked == []  # the library is asked about other characters only
    for unit in units:
        assert segment_bpe._ASCII(unit) == [unit[a:b] for _, (a, b) in split(unit)]
    own.told.learn([["é,", " \x1cb.", "\n."]])
    assert sorted(asked) == sorted(["é,", " \x1cb.", "\n."])


def test_odd_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(A, encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        segment_bpe.Vocabulary(str(path))


def test_groups_equal_all_common_ends():
    r, many = random.Random(2), []
    for _ in range(600):
        n = r.randint(1, 60)
        a, b = (sorted(r.sample(range(1, n), r.randint(0, n - 1))) + [n] for _ in range(2))
        common = sorted(set(a) & set(b))
        expected, x, y = [], 0, 0
        for end in common:
            i, j = a.index(end) + 1, b.index(end) + 1
            expected.append((x, i, y, j))
            x, y = i, j
        assert cross_align.groups(a, b) == expected
        many.append((a, b, expected))
    assert cross_align.groups([], []) == []
    # all of them as one run of texts
    starts = [np.cumsum([0, *(len(x[side]) for x in many)]) for side in (0, 1)]
    shift = np.cumsum([0, *(x[0][-1] for x in many)])
    ends = [np.concatenate([np.array(x[side]) + s for x, s in zip(many, shift)]) for side in (0, 1)]
    found = cross_align.groups_many(*ends, *starts).tolist()
    assert found == [
        [p + i, q + i, u + j, v + j]
        for (_, _, rows), i, j in zip(many, starts[0].tolist(), starts[1].tolist())
        for p, q, u, v in rows
    ]


def aligned_by_hand(texts):
    """Each text as a whole by the libraries, cut at every common end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: i for i, c in enumerate(segment_bpe.byte_letters())}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed and b.is_byte(i) else piece.replace("▁", " ").encode()

    rows, pairs_of = [], []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes_b(i) for i in ids_b]
        data = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != data or b"".join(parts_b) != data:
            rows.append((0, 0, 0, 0, ""))
            pairs_of.append(Counter())
            continue
        ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        shown, pairs, x, y = [], Counter(), 0, 0
        for end in common:
            i, j = ends[0].index(end) + 1, ends[1].index(end) + 1
            pairs.update((p, q) for p in ids_a[x:i] for q in ids_b[y:j])
            shown.append(f"{','.join(map(str, ids_a[x:i]))}|{','.join(map(str, ids_b[y:j]))}")
            x, y = i, j
        rows.append((len(ids_a), len(ids_b), len(common), pairs.total(), sha(";".join(shown))))
        pairs_of.append(pairs)
    counts = Counter(p for pairs in pairs_of for p in pairs)
    most: dict = {}
    for (p, _), n in counts.items():
        most[p] = max(n, most.get(p, 0))
    return [
        (*row[:4], sum(k for p, k in pairs.items() if counts[p] == most[p[0]]),
         sum(k * counts[p] for p, k in pairs.items()), row[4])
        for row, pairs in zip(rows, pairs_of)
    ]


@pytest.mark.parametrize("frequent", [0, 40, cross_align.FREQUENT])
def test_alignment_equals_whole_texts(spark, frequent):
    texts = [t for t in odd_texts(700) if not t or len(t) < 3000]
    texts += texts[700:720]
    docs = spark.createDataFrame(rows_of(texts) + [(None, "null id", "", 0, "", 0, 0)], DOCS)
    found = cross_align.align(docs, A, B, frequent).collect()
    assert len(found) == len(texts) + 1
    expected = aligned_by_hand([*texts, "null id"])
    assert {r.doc_id: tuple(r)[1:] for r in found} == dict(zip([*range(len(texts)), None], expected))


def test_alignment_stays_on_its_core():
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(3, 12))) for _ in range(40_000))]
    pair = cross_align.pair_of(A, B)
    whole, own = time.process_time(), time.thread_time()
    pair.align(texts)
    whole, own = time.process_time() - whole, time.thread_time() - own
    assert whole < 1.15 * own + 0.05


@pytest.mark.parametrize("held", [1, 100])
def test_links_counted_in_parts_are_the_same(monkeypatch, held):
    text = " ".join(["one two", "three", "x1.y", "one two three"] * 400)
    pair = cross_align.pair_of(A, B)
    at_once = pair.align([text])[0]
    monkeypatch.setattr(cross_align, "HELD", held)
    parts = cross_align._Aligned()
    found = text_units.units(f" {text}")
    for start in range(0, len(found), 37):
        parts.add(found[start : start + 37], pair.told)
    assert parts.numbers() == at_once.numbers() and parts.digest() == at_once.digest()
    for one, other in zip(parts.links(), at_once.links()):
        assert one.tolist() == other.tolist()
    assert not at_once.held and len(at_once.links()[0]) < at_once.numbers()[3]


def test_alignment_of_nothing(spark):
    assert cross_align.align(spark.createDataFrame([], DOCS), A, B).collect() == []


def ranked_by_hand(docs, items, k):
    pattern = re.compile(impact_search.TERM)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda text: Counter(pattern.findall((text or "").translate(fold)))
    bags = [(doc, cut(text)) for doc, text in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n_docs, length = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    found = []
    for item, text in items:
        rows = []
        for doc, bag in bags:
            m = 100 - 50 + 50 * bag.total() * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in cut(text) if t in bag
            )
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        found += [(item, i + 1, row[3], -row[0]) for i, row in enumerate(sorted(rows)[:k])]
    return found


@pytest.mark.parametrize("shard,first", [(7, 1), (100, 3), (1 << 16, 32)])
def test_search_equals_brute_force(spark, monkeypatch, shard, first):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x1", "日本", "THE", "the"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "-", "\n", "_", "..."]) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 20, 120]))) for i in range(400)]
    docs += [(500 + i, docs[5][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[5][1]), (901, None), (902, "..")]
    docs += [(903, "w1 " * 20000)]
    items = [(i, text(r.choice([1, 6, 30]))) for i in range(15)] + [(15, None), (16, ""), (17, "unknown"), (2, "w1 w2"), (18, docs[5][1])]
    table = spark.createDataFrame([(d, t, "", 1, "", 2, 3) for d, t in docs], DOCS).repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    import inspect

    source = inspect.getsource(impact_search._shards)
    assert "SHARD_DOCS" in source
    got = Counter()
    # shards and first reads of any size give the same rows
    bags = {}
    vocabulary = sorted({t for _, t in items for t in impact_search.terms(t)})
    found = impact_search.postings(table, vocabulary).collect()
    n_docs, length = len(found), sum(x.n for x in found)
    df = Counter(t for x in found for t in x.terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(vocabulary))])
    monkeypatch.setattr(impact_search, "FIRST_READ", first)
    for item, (_, query) in enumerate(items):
        asked = np.array(sorted(vocabulary.index(t) for t in impact_search.terms(query)), np.int64)
        rows, least = [], 1
        for start in range(0, n_docs, shard):
            part = found[start : start + shard]
            one = impact_search.Shard(
                weights, np.array([50 + 50 * x.n * n_docs // length for x in part]),
                np.array([len(x.terms) for x in part]), np.array([t for x in part for t in x.terms], np.int64),
                np.array([t for x in part for t in x.tfs], np.int64),
            )
            places, scores = one.best(asked, 10, least)
            rows += [(part[p].doc_id, s) for p, s in zip(places.tolist(), scores.tolist())]
            rows = sorted(rows, key=impact_search._order)[:10]
            least = rows[-1][1] if len(rows) == 10 else 1
        bags[item] = rows
        got.update((item, i + 1, d, s) for i, (d, s) in enumerate(rows))
    by_place = [(i, t) for i, (_, t) in enumerate(items)]
    assert got == Counter(ranked_by_hand(docs, by_place, 10))
    result = Counter(tuple(x) for x in impact_search.search(table, queries, 10).collect())
    assert result == Counter(ranked_by_hand(docs, items, 10))


def test_search_in_blocks_and_of_nothing(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(50)]
    items = [(i, f"a{i} b1 zz") for i in range(7)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(impact_search, "BLOCK_ITEMS", 3)
    found = [tuple(r) for r in impact_search.search(table, queries, 5).collect()]
    assert Counter(found) == Counter(ranked_by_hand(docs, items, 5))
    assert impact_search.search(table.limit(0), queries).collect() == []
    assert impact_search.search(table, queries.limit(0)).collect() == []


def test_best_positions_stop_early():
    n = 5000
    weights = np.array([1000, 900])
    sizes = np.full(n, 2)
    one = impact_search.Shard(
        weights, np.arange(50, 50 + n), sizes, np.tile([0, 1], n), np.ones(2 * n, np.int64)
    )
    docs, scores = one.best(np.array([0, 1]), 10)
    assert sorted(docs.tolist()) == list(range(10)) and len(scores) < 100
