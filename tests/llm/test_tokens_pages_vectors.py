"""BPE, packing, extraction and search."""

from __future__ import annotations

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastemill.llm import cutting, hostpaths, rankqueue, vptree
from tastemill.llm.shared import tables

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- BPE ----------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abt heér \n'1<|>世😀"), max_size=60))
def test_encodes_as_the_public_library(reference, text):
    coder = rankqueue.encoder(RANKS, public_tokenizers.PATTERN)
    ids = coder.encode([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    assert coder.merges.decode(ids) == text.encode()


def test_very_long_pretoken(reference):
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    coder = rankqueue.encoder(RANKS, public_tokenizers.PATTERN)
    assert coder.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_cache_of_bounded_size_changes_nothing(reference, monkeypatch):
    """Young and old halves of some entries each; frequent pre-tokens move over, rare ones come again."""
    monkeypatch.setattr(rankqueue, "CACHE_BYTES", 3000)
    monkeypatch.setattr(rankqueue, "QUEUED_BYTES", 40)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    coder = rankqueue.Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(40):
        texts = [" the ".join(rng.choices(words, k=8)) for _ in range(5)]
        assert [x.tolist() for x in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
        assert coder.held < 3000 + 60 * 400 and len(coder.young) < 200


@pytest.mark.parametrize("alphabet", ["ab", "aé", "abcdefghij"])
def test_lower_ranks_that_come_up_go_first(alphabet):
    """A vocabulary whose ranks do not grow with the tokens' making, against plain lowest-rank merging."""
    rng = random.Random(6)
    singles = [bytes([b]) for b in range(256)]
    made = {"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 5))).encode() for _ in range(80)}
    vocabulary = singles + rng.sample(sorted(made), len(made))
    lines = [base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(vocabulary)]
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".tiktoken") as f:
        f.write(b"\n".join(lines))
        f.flush()
        coder = rankqueue.Merges(f.name)
    ranks = {t: i for i, t in enumerate(vocabulary)}

    def plain(raw: bytes) -> list[int]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            near = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not near:
                return [ranks[p] for p in parts]
            i = min(near)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))).encode() for _ in range(60)]
    assert coder.encode(pieces) == [plain(p) for p in pieces]
    assert coder.encode([]) == [] and coder.encode([b""]) == [[]]


def test_encode_table(docs, none, reference):
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = rankqueue.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert (r["doc_id"], text or None) in texts or (r["doc_id"], text) in texts
        assert list(r["ids"]) == reference.encode_ordinary(text)
    assert rankqueue.encode_and_decode(none, RANKS, public_tokenizers.PATTERN).collect() == []


# --- packing ------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1024, 64])
def test_every_id_lies_in_one_piece(spark, docs, size):
    special = spark.createDataFrame([(-5, "a <|endoftext|> b"), (-6, "word " * 700)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(special)
    tokenizer = Tokenizer.from_file(FILE)
    ids = defaultdict(list)
    for r in frame.collect():
        ids[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    rows = cutting.pack(frame, FILE, size=size, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc, want in ids.items():
        joined = defaultdict(int)
        for r in pieces[doc]:
            joined[(r["start"], tuple(r["ids"]))] += 1
        expected = defaultdict(int)
        for one in want:
            for start in range(0, len(one), size):
                expected[(start, tuple(one[start : start + size]))] += 1
        assert joined == expected
        assert {r["doc_tokens"] for r in pieces[doc]} == {len(one) for one in want}
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size


def test_pieces_are_coded_as_the_tokenizer_codes_them():
    from tokenizers import Tokenizer, normalizers

    pieces = [" word", "word", "'s", "\n\n", " \t", " größer", "日本", " 🙂", "\x00\x7f", "\xa0", "\xad", " 12", " ...", "A", "~"]
    tokenizer = Tokenizer.from_file(FILE)
    expected = [e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    assert list(cutting.coder_of_pieces(tokenizer)(pieces)) == expected
    assert cutting.byte_letters().keys() == set(range(256)) and len(set(cutting.byte_letters().values())) == 256
    # another file's steps before the merges are kept
    tokenizer.normalizer = normalizers.Lowercase()
    assert list(cutting.coder_of_pieces(tokenizer)(["Word"])) == [tokenizer.encode("word", add_special_tokens=False).ids]


def test_columns_reach_the_bound():
    """Halves and thirds: the linear program finds the patterns that leave nothing over."""
    sizes, demand = np.array([2, 3, 5]), np.array([50, 50, 50])
    patterns = cutting.solve_patterns(sizes, demand, 10)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert sum(n for _, n in patterns) <= 51
    assert all((p * sizes).sum() <= 10 for p, _ in patterns)


@pytest.mark.parametrize("words", [2, 4, 8, 12])
def test_short_documents_are_packed_full(spark, words):
    """Documents of 3 to 13 ids, each sequence but the last few at least 95 % full."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a" + " a" * (words - 1)).alias("text")).repartition(5)
    rows = cutting.pack(frame, FILE).collect()
    assert len(rows) == 4000 and {r["length"] for r in rows} == {words + 1}
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in held.values():
        assert [o for o, _ in sorted(some)] == [i * (words + 1) for i in range(len(some))] and len(some) * (words + 1) <= 1024
    fills = sorted(len(some) * (words + 1) / 1024 for some in held.values())
    assert fills[1] >= 0.95


def test_items_hold_every_rank_once():
    counts = {1: 7, 5: 4, 9: 103, 64: 9, 65: 3, 1000: 2, 1024: 6}
    rows, demand = cutting.items_of(counts, 1024, 4)
    for length, n in counts.items():
        mine = sorted(r for r in rows if r[0] == length)
        assert mine[0][1] == 0 and mine[-1][2] == n and all(a[2] == b[1] for a, b in zip(mine, mine[1:]))
        assert all(length * each <= 4 * unit for _, _, _, each, unit, _ in mine)
    for unit, n in demand.items():
        taken = sorted((r[5], r[5] + (r[2] - r[1]) // r[3]) for r in rows if r[4] == unit)
        assert taken[0][0] == 0 and taken[-1][1] == n and all(a[1] == b[0] for a, b in zip(taken, taken[1:]))


def test_pack_nothing(none):
    assert cutting.pack(none, FILE).collect() == []


# --- pages --------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{{}}</style><script>x="</p><p>no"</script></head><body>
<div class="menu-{n}"><a href="/">home</a><a href="/b">more links here</a></div>
<div class="post-{n}"><h1>Head {n}</h1><p>First &amp; long paragraph of running text, number {n}.<p>Second  one<br>with   a break &lt;b&gt;.</p>
<div class="ad">buy</div><form><p>mail</p></form><ul><li>item one</li><li>item two</li></ul><div class="comments"><p>I do not agree at all with this article.</p></div></div>
<footer><p>copyright</p></footer></body></html>"""


def test_pages(spark):
    rows = [(n, f"http://h.example/{n}?x", PAGE.format(n=n)) for n in range(8)]
    rows += [(50, "http://h.example/e", None), (51, None, "<p>alone"), (52, "http://h.example/o", "<main><p>Other layout with some text.</p></main>"), (53, "x", ""), (0, "http://h.example/0?x", PAGE.format(n=0))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = hostpaths.extract(frame).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for n in range(8):
        assert text[n] == f"Head {n}\nFirst & long paragraph of running text, number {n}.\nSecond one with a break <b>.\nitem one\nitem two"
    assert text[50] == "" and text[51] == "alone" and text[53] == "" and text[52] == "Other layout with some text."
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert hostpaths.extract(frame.where("false")).collect() == []


LONG = "Running text of the article that goes on for a while and then for a while longer."


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'id="page" class="no-sidebar"', 'class="row with-banner"', 'class="col hidden-xs"', 'class="sidebar-right"', 'class="hidden"'])
def test_layout_names_do_not_hide_the_article(spark, wrapper):
    html = f'<body><nav>n</nav><div {wrapper}><div class="post-header"><h1>Head</h1></div><p>{LONG}</p><div class="sidebar">Elsewhere</div><p class="notice">Note<p>{LONG}</p></div></body>'
    frame = spark.createDataFrame([(n, f"http://h.example/{n}", html) for n in range(3)], "page_id long, url string, html string")
    assert [r["text"] for r in hostpaths.extract(frame).collect()] == [f"Head\n{LONG}\n{LONG}"] * 3


@pytest.mark.parametrize("part", ['class="comments"', 'id="comments" class="post-comments"', 'class="site-footer"', 'class="comment-list"'])
def test_marked_parts_stay_hidden(part):
    talk = f"<p>{LONG}</p>" * (3 if "comments" in part else 1)
    blocks = hostpaths.blocks_of(f"<body><div><h1>Head</h1><p>{LONG}</p><div {part}>{talk}</div></div></body>")
    assert [text for _, text, _ in blocks] == ["Head", LONG]


P, U = f"<p>{LONG}</p>", f"<li>{LONG}</li>"
BODY = f'<div class="body">{P * 9}</div>'
LAYOUTS = {
    "lead": (f"<article><h1>Head</h1><p>Lead</p>{BODY}</article>", ["Head", "Lead"] + [LONG] * 9),
    "list": (f"<article>{P * 3}<ul>{U * 7}</ul></article>", [LONG] * 10),
    "sections": (f'<div class="post"><section class="a">{P * 6}</section><section class="b">{P * 2}</section></div>', [LONG] * 8),
    "beside": (f'<section class="a">{P * 6}</section><section class="b">{P * 2}</section>', [LONG] * 8),
    "head": (f'<div class="post"><div class="top"><h1>Head</h1></div>{BODY}</div><div class="legal">Some company</div>', ["Head"] + [LONG] * 9),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_text_beside_the_longest_container_stays(name):
    html, want = LAYOUTS[name]
    assert hostpaths.read_page(f"<html><body>{html}</body></html>", None).split("\n") == want


def test_pages_of_another_template_keep_their_text(spark):
    main = f'<body><div class="post">{P * 3}</div></body>'
    other = f'<body><div class="post"><p>Small</p></div><div class="story">{P * 4}</div></body>'
    third = f'<body><div class="essay"><h1>Own</h1>{P}</div></body>'
    rows = [(n, f"http://h.example/{n}", main if n < 30 else other if n < 34 else third) for n in range(35)]
    got = {r["page_id"]: r["text"].split("\n") for r in hostpaths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(35):
        assert [t for t in got[n] if t != "Small"] == ([LONG] * 3 if n < 30 else [LONG] * 4 if n < 34 else ["Own", LONG])


def test_pages_of_the_tables(spark, root):
    got = hostpaths.extract(tables(spark, root, "pages"))
    assert got.where("n_chars = 0").count() == 0 and got.where("text like '%©%'").count() == 0


# --- search -------------------------------------------------------------------------------


def brute_search(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = []
    for q in sorted(good):
        if q % 4 == 0:
            scored = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=8) * 0.4).astype(np.float32)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(900, None), (904, [0.0] * 8), (908, [1.0, None] + [0.0] * 6), (912, [float("nan")] * 8), (916, [float("inf")] * 8), (920, [1.0] * 3), (924, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(frame, F.col("vec_id") % 4 == 0, k=7, relax=1.0, shard_rows=shard_rows).collect())
    expected = brute_search(rows, 7)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected])


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], schema)
    got = vptree.nearest(frame, F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.0)]
    assert vptree.nearest(frame.where("false"), F.lit(True)).collect() == []


def test_recall_on_the_table(spark, root):
    frame = tables(spark, root, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    got = defaultdict(set)
    for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_vectors_of_two_widths_each_find_their_own(spark):
    """As many of three components as of five, one of seven; every list as by brute force in its width."""
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=3 if i % 2 else 5).tolist()) for i in range(600)] + [(600, rng.normal(size=7).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS width", "2 AS shards").repartition(3)
    got = defaultdict(list)
    for r in vptree.nearest(frame, F.col("vec_id") % 10 < 2, k=5, relax=1.0, shard_rows=100).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: np.array(v) for i, v in rows}
    for query in [i for i in vectors if i % 10 < 2]:
        near = sorted((-float(vectors[query] @ v), i) for i, v in vectors.items() if i != query and len(v) == len(vectors[query]))[:5]
        found = sorted(got.get(query, []))
        assert [(r, v) for r, v, _ in found] == [(n, i) for n, (_, i) in enumerate(near, 1)]
        assert [s for *_, s in found] == pytest.approx([-s for s, _ in near])
    assert 600 not in got
