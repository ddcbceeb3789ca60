"""The corpus operators against brute force, round trips, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from stackfall.llm import (
    bpe, language_id, mixing, ngram_join, quality_classifier, quality_rules, toxicity, trie,
    url_filter, vp_tree, warc,
)
from stackfall import session
from stackfall.session import scratch_path

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_words long"
LABELS = "doc_id long, quality int, toxic int"


def jaccard_classes(rows, percent=75):
    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for group in range(12):
        base = [r.choice(words) for _ in range(r.randint(4, 90))]
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            if group % 3 == 0:
                own += passage
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "ONE TWO"), (905, "x")]
    return rows


@pytest.mark.parametrize("block_docs", [3, 1024])
def test_ngram_join_finds_the_components_of_all_pairs(spark, block_docs):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], DOCS)
    got = ngram_join.join(docs, block_docs=block_docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_classes(rows)


def test_ngram_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "A  b")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == {(None, 1, None): 1, (1, 1, 1): 2, (2, 1, 1): 1}
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_ngram_join_compares_every_text_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = a.replace("a59", "other")
    rows = [(3, b), (5, a), (5, b), (5, a), (7, near), (8, "c " + near), (9, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == {(3, 3): 1, (5, 3): 3, (7, 3): 1, (8, 3): 1, (9, 9): 1}
    # the second text of the smallest id, in blocks that leaders split
    rows = [(1, a), (1, b), *((i, b.replace("b59", f"x{i}")) for i in range(2, 9)), (9, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.join(docs, block_docs=2).collect()} == {1}


def linked_documents(rows, percent=75):
    """Per row the other (id, set) nodes whose set links with the row's."""
    sets = []
    for doc, text in rows:
        w = (text or "").lower().split()
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    nodes = {x for x in sets if x[0] is not None}
    near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return [(d, sum(n != (d, s) and bool(s) and near(s, n[1]) for n in nodes) if d is not None else 0) for d, s in sets]


@pytest.mark.parametrize("block_docs", [3, 1024])
def test_ngram_join_counts_every_link(spark, block_docs):
    rows = near_copies()
    rows += [(1000 + i, rows[i % 7][1]) for i in range(12)]  # copies
    rows += [(0, rows[40][1]), (3, rows[3][1]), (1000, rows[9][1]), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs, block_docs=block_docs, count_links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter(linked_documents(rows))


def test_ngram_join_keeps_less_on_disk_than_it_reads(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(900)] for _ in range(4)]
    rows = []
    for base in bases:
        for _ in range(60):  # more near copies than are compared in pairs
            own = list(base)
            own[r.randrange(len(own))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, cut = [], ngram_join.cut

    def measured(*a, **k):
        made = cut(*a, **k)
        held.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return made

    monkeypatch.setattr(ngram_join, "cut", measured)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    got = ngram_join.join(docs, count_links=True).collect()
    assert {(x.doc_id, x.component_id, x.n_links) for x in got} == {(d, d // 60 * 60, 59) for d, _ in rows}
    texts = sum(len(t) for _, t in rows)
    assert max(held) < texts and held[-1] < texts / 10


def test_ngram_join_counts_links_of_a_large_block_in_turns(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turns, cut = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name, **k: (turns.append(name), cut(df, name, **k))[1])
    monkeypatch.setattr(ngram_join, "TURN_ROWS", 60)
    got = ngram_join.join(docs, block_docs=2, count_links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter(linked_documents(rows))
    assert turns.count("turn") > 1


def test_trie_finds_every_link():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 25))).astype(np.uint64) for _ in range(80)]
    want = {
        (i, j)
        for i in range(80) for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
    }
    got = {(max(p), min(p)) for p in trie.links(sets, 60, all_links=True)}
    assert got == want


def test_rules_on_odd_rows(spark):
    long = " ".join(f"the w{i} of x{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 7), (2, "", "en", "s", 7), (None, long, "en", "s", 7),
         (4, long + " |" * 90, "en", "s", 7), (5, "a b c " * 30, "en", "s", 7)], DOCS,
    )
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert (got[1].n_words, got[1].base_failed, got[2].kept) == (0, True, False)
    assert got[None].kept and not got[4].kept and not got[4].base_failed
    assert got[5].n_repeat_words == 90 and got[5].base_failed
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.n_words) for r in kept.collect()] == [(None, 7)]
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_discriminant_learns_and_survives_missing_labels(spark):
    good = "the lake of a town is in the hills and was old by name here with trees"
    rows = [(i, good + f" number{i} x{i * 7} y{i % 5}" if i % 2 else "&& ## | " * (5 + i % 4), "", "s", 0) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 1)], LABELS)
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(200))
    assert 0 <= got[900].score <= 1
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_counterfactual_penalty_takes_weight_from_group_terms():
    rows = [({"women", "awful", f"a{i}"}, 1) for i in range(30)]
    rows += [({"men", f"b{i}"}, 0) for i in range(30)] + [({"awful", f"c{i}"}, 1) for i in range(30)]
    plain = toxicity.train(rows, counterfactual=0.0)
    fair = toxicity.train(rows, counterfactual=20.0)
    gap = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.score("those women are nice") < fair.score("awful")


def test_counterfactual_penalty_reaches_the_beginnings_of_group_terms():
    texts = [(f"those muslims were seen a{i}", 1) for i in range(40)]
    texts += [(f"the lake was seen b{i}", 0) for i in range(40)] + [(f"awful lake c{i}", 1) for i in range(40)]
    rows = [(toxicity.tokens(t), y) for t, y in texts]
    fair = toxicity.train(rows, counterfactual=20.0)
    logit = lambda t: np.log(fair.score(t) / (1 - fair.score(t)))
    assert abs(logit("muslims by the lake") - logit("christians by the lake")) < 0.3
    swapped = toxicity.exchanges(toxicity.tokens("muslims like muslin"))
    gone, new = next(x for x in swapped if "jews" in x[1])
    assert gone == {"muslims", "muslim*"} and new == {"jews"}


def test_counterfactual_penalty_over_a_table(spark):
    rows = [(i, f"those muslims were seen a{i}" if i % 2 else f"the lake was seen b{i}", "", "s", 0) for i in range(160)]
    docs = spark.createDataFrame([*rows, (900, "muslims by the lake", "", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)], LABELS)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 161 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 160)


def test_language_filters(spark):
    en, de = "the weather in the north is fine", "das wetter im norden ist schön"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s", 0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en", "s", 0), (101, "12 3!", None, "s", 0)], DOCS)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert (got[100].lang_pred, got[101].lang_pred, got[100].score) == ("und", "und", 0.0)


def test_url_rules_and_parts(spark):
    urls = ["https://www.Example.com/en/1?x#y", "http://a.example.com/en/", "http://x.com/a", "http://x.com",
            "http://b.net/es/1", "nothing", None, "http://spam-farm.example.org/en/1"]
    got = [tuple(r)[1:5] for r in url_filter.judge(
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3][:3] == ("x.com", "", None) and got[4][2] == "net/es/"
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7][3] == "block"


def test_url_parts_end_at_the_first_address(spark):
    urls = ["http://x.net?u=http://y.org/es/1", "http://a.com#http://b.net/c", "http://c.net/es/?u=http://d.org/q",
            "http://A.net?://", "://", "a/b://h/p", "x://\n/y\nz?q", "mailto:a?b=http://e.net/fr/2", "k" * 50_000]
    got = [tuple(r)[1:4] for r in url_filter.judge(
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [r[:2] for r in got] == [url_filter.split(u) for u in urls]
    assert got[0] == ("x.net", "", None) and got[1] == ("a.com", "", None)
    assert got[2][2] == "net/es/" and got[7] == ("e.net", "/fr/2", "net/fr/")


def test_transducer_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = bpe.Encoder(ranks, public.PATTERN), random.Random(5)
    table = bpe._vocabulary(public.path("byte_bpe_50k.tiktoken"))
    letters = "abcdeeetthhion  \n\t'sE01é漢🎉ß,.-"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(800)]
    texts += ["!\x1c.. \x1c", "a\xa0 b\n\n c", "word " * 4000, "x" * 3000, "\r\n \t"]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids == own.encode_ordinary(text)
        assert bpe.decode_ids(ids, table) == text


def test_transducer_has_no_more_states_than_the_vocabulary_has_beginnings(monkeypatch):
    r = random.Random(8)
    tokens, letters = [bytes((b,)) for b in range(256)], b"abcdef"
    for _ in range(300):
        token = r.choice(tokens[97:103] + tokens[256:]) + r.choice(tokens[97:103] + tokens[256:])
        if len(token) < 9 and token not in tokens:
            tokens.append(token)
    ranks = {token: rank for rank, token in enumerate(tokens)}
    machine = bpe.Transducer(ranks)
    pieces = [bytes(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in range(3000)]
    expected = [[ranks[piece]] if piece in ranks else [ranks[t] for t in machine.merge(piece)] for piece in pieces]
    assert [list(machine.encode(piece)) for piece in pieces] == expected
    assert len(machine._states) <= len(machine.kind) + 1
    for name, few in (("PAIRS", 16), ("ROWS", 7), ("MAX_STATES", 20)):
        monkeypatch.setattr(bpe, name, few)
    small = bpe.Transducer(ranks)
    assert [ids for at in range(0, 3000, 50) for ids in small.encode_all(pieces[at : at + 50])] == expected


def test_a_worker_that_forgets_frees_its_tables():
    import gc
    import weakref

    path = public.path("byte_bpe_50k.tiktoken")
    encoder = bpe._encoder(path, public.PATTERN)
    encoder.digests(["some words, twice", "some words"])
    held = weakref.ref(encoder)
    del encoder
    gc.disable()
    try:
        bpe.forget()
        assert held() is None
    finally:
        gc.enable()


def test_byte_bpe_round_trip_of_odd_rows(spark, monkeypatch):
    import tiktoken
    from pyspark.sql import functions as F

    path = public.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["Plain text, twice.", "Plain text, twice.", "", None, "漢字 🎉\n\n  end ", "<|endoftext|>", "many words " * 40_000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, 0), (0, texts[0], "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = Counter()
    for doc, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        expected[doc, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids))] += 1
    for keep in (True, False, True):
        found = bpe.round_trip(docs, path, public.PATTERN, keep=keep).collect()
        assert Counter(tuple(r) for r in found) == expected
    both = docs.select("text", bpe.encode(F.col("text"), path, public.PATTERN).alias("ids"))
    assert all(r.back == (r.text or "") for r in both.withColumn("back", bpe.decode(F.col("ids"), path)).collect())
    assert bpe.round_trip(docs.limit(0), path, public.PATTERN).collect() == []


def test_mix_meets_every_window_and_keeps_every_row(spark):
    rows = [(i, None, "", None if i % 11 == 0 else f"s{i % 3}", 0) for i in range(900)]
    docs = spark.createDataFrame([*rows, rows[5], (None, None, "", "s1", 0)], DOCS)
    got = mixing.mix(docs, {"s0": 5, "s1": 2, "s2": 1}, block_rows=4, slots=16).collect()
    assert len(got) == 902
    assert len({(r.slot, r.place) for r in got}) == 902
    assert all(r.release <= r.slot < r.deadline for r in got)
    whole = mixing.whole_weights({"s0": 5, "s1": 2, "s2": 1, None: 1}, 16)
    done = Counter()
    for source, _, slot in mixing.frame(whole):
        done[source] += 1
        assert all(abs(done[s] - whole[s] * (slot + 1) / 16) < 1 for s in whole)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "targets, blocks",
    [
        ({f"s{i}": (i + 1) ** 0.5 for i in range(20)}, 1500),  # no multiples of one over the slots
        ({"a": 1.0, "b": 0.7, "tiny": 1e-4}, 20000),  # less than one slot of a frame
        ({f"s{i:02}": 1.0 + i for i in range(40)}, 60),  # more sources than slots
    ],
)
def test_mix_stays_within_a_block_of_the_asked_weights(targets, blocks):
    total = sum(targets.values())
    ends = {s: max(1, int(blocks * w / total)) for s, w in targets.items()}
    plan = mixing._plan(mixing.exact_weights(targets), ends, 16).to_pylist()
    assert Counter(r["_t"] for r in plan) == ends
    assert len({r["slot"] for r in plan}) == len(plan)
    done = Counter()
    for r in plan:
        s, share = r["_t"], targets[r["_t"]] / total
        assert r["_k"] == done[s] and r["release"] <= r["slot"] < r["deadline"]
        assert abs(done[s] - share * r["slot"]) < 1 + 1e-9
        done[s] += 1
        assert abs(done[s] - share * (r["slot"] + 1)) < 1 + 1e-9


def test_mix_of_many_sources_over_many_frames(spark):
    targets = {f"s{i}": 1 + i**0.5 for i in range(30)}
    docs = spark.createDataFrame([(i, None, "", f"s{i % 30}", 0) for i in range(3000)], DOCS)
    got = mixing.mix(docs, targets, block_rows=2, slots=16).collect()
    assert len({(r.slot, r.place) for r in got}) == 3000
    total = sum(targets.values())
    for r in got:
        share = targets[r.source] / total
        assert r.release <= r.slot < r.deadline
        assert abs(r.release - r.block_no / share) <= 1 and abs(r.deadline - (r.block_no + 1) / share) <= 1


def test_archive_round_trip(spark):
    big = "é" * 500
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "x", ""), (None, "n", "k" * 300),
            (5, "y", "a\r\n\r\nWARC/1.1\r\nb" * 9), (6, "z", "end\r\n\r\n"), (9, "r", "k" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (7, 1 << 16):
        got = warc.round_trip(pages, scratch_path(spark, "warc"), chunk_bytes=chunk).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
            (p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows
        )
        assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(2, 1)]


def test_trees_find_the_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8))
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vp_tree.search(frame, frame.where("vec_id % 50 = 0"), shard_rows=64).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 300, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        want = np.lexsort((np.arange(300), -score))[:5].tolist()
        assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == want
    assert len(got) == 30


def test_interleave_lays_rows_out_by_slots(spark):
    from fractions import Fraction

    rows = [(i, "text", "en", f"s{i % 7 % 3}", i) for i in range(5000)]
    rows += [(None, None, None, None, i) for i in range(40)] + [rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _h int")
    weights = {"s0": 5, "s1": 2, "s2": 1, None: 0.5}
    out = mixing.interleave(docs, weights, block_rows=8, slots=16).coalesce(1)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(rows)
    # as long as no source has ended, each is within a block and its last, cut one of its share
    left = Counter(r[3] for r in rows)
    total, done = Fraction(17, 2), Counter()
    for at, row in enumerate(got, 1):
        done[row[3]] += 1
        if done[row[3]] == left[row[3]]:
            break
        for name, weight in weights.items():
            assert abs(done[name] - at * Fraction(weight) / total) < 2 * 8
    assert at > 600
    assert mixing.interleave(docs.limit(0)).collect() == []


def test_mix_keeps_columns_that_begin_with_an_underscore(spark):
    docs = spark.createDataFrame([(i, "a", i, "x") for i in range(9)], "doc_id long, source string, _s int, slot string")
    out = mixing.mix(docs, block_rows=2)
    assert set(out.columns) == {"doc_id", "source", "_s", "block_no", "release", "deadline", "slot", "place"}
    assert sorted(r["_s"] for r in out.collect()) == list(range(9))


def nearest_by_hand(rows, k=5):
    """Exact cosines of all pairs, one vector a repeated id."""
    first = {}
    for i, v in rows:
        if v and i is not None:
            first[i] = min(first.get(i, v), v)
    ids = sorted(first)
    vectors = np.array([first[i] for i in ids], np.float64)
    out = {}
    for a, i in enumerate(ids):
        if i % 50 == 0:
            others = [b for b in range(len(ids)) if b != a]
            scores = vp_tree.cosine(np.repeat(vectors[[a]], len(others), 0), vectors[others])
            ranked = sorted(zip(-scores, (ids[b] for b in others)))[:k]
            out[i] = [(j, -s) for s, j in ranked]
    return out


def found_by_tree(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    got = {}
    for r in vp_tree.search(df, df.where("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_near_ties_and_repeated_ids_are_exact(spark):
    r = np.random.default_rng(8)
    one = r.normal(size=24).astype(np.float32)
    rows = [(i, (one * np.float32(1 + i * 0.37)).tolist()) for i in range(60)]
    rows += [(100 + i, r.normal(size=24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(100, rows[70][1]), (1, rows[1][1]), (3, rows[90][1]), (0, rows[5][1])]
    for options in ({}, {"shard_rows": 40}):
        assert found_by_tree(spark, rows, **options) == nearest_by_hand(rows)


def test_relaxed_factor_keeps_most_neighbours_and_nothing_gives_nothing(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.2 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    exact = nearest_by_hand(rows)
    found = found_by_tree(spark, rows, factor=2.0)
    hits = sum(len({j for j, _ in exact[q]} & {j for j, _ in found[q]}) for q in exact)
    assert hits >= 0.9 * 5 * len(exact)
    assert found_by_tree(spark, [(i, None) for i in range(3)]) == {}
    assert found_by_tree(spark, [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, [0.5, float("nan")])]) == {}


def test_grams_are_the_same_however_a_text_is_cut(monkeypatch):
    r = random.Random(4)
    for _ in range(50):
        text = "".join(r.choice("abÉ ıİ漢\n") for _ in range(r.randint(0, 60)))
        whole = Counter(np.concatenate(list(language_id.grams(text))).tolist())
        for piece in (1, 2, 5, 17):
            monkeypatch.setattr(language_id, "_PIECE", piece)
            assert Counter(np.concatenate(list(language_id.grams(text))).tolist()) == whole
        monkeypatch.undo()
        padded = f" {text} ".lower()
        assert whole.total() == sum(max(0, len(padded) - n + 1) for n in language_id.SIZES)


def test_languages_of_an_empty_table_ties_and_long_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty).collect() == []
    english, french = "the weather and the house that was there ", "une maison avec des fleurs et du pain "
    rows = [(i, (english if i % 2 else french) * 3, "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    rows += [(900, french + english * 60_000, None, "s", 0), (901, "???", None, "s", 0), (902, "ж", None, "s", 0), (902, "ж", None, "s", 0)]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[900].lang_pred == "en" and found[901].lang_pred == "und"
    assert found[902].lang_pred == "en" and found[902].score == 0
