"""Mixing, token files, packing, page text, top-k and the pipeline."""

import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import duck, mismatch
from conftest import SF
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SPACES, WORDS, near_components, odd_docs, odd_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowtables.llm import html_text, language, mixing, packing, token_files, topk  # noqa: E402
from flowtables.llm.encoding import PieceEncoder, encoder  # noqa: E402
from flowtables.llm.queries import ORACLES, QUERIES  # noqa: E402

BYTES, WORDY = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()) is None


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    plan = mixing.plan_mix(docs).collect()
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    assert len(plan) == docs.count()
    source = defaultdict(int)
    for r in odd_rows():
        source[r[3]] += len(WORDS.findall(r[1] or ""))
    for r in plan:
        assert r.taken <= 3 * r.size and r.source_size in source.values()
        sizes[r.source_size] += r.size
        targets[r.source_size] = r.target
        taken[r.source_size] += r.taken
    assert abs(sum(targets.values()) - sum(source.values())) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= 4000 and targets[s] <= 3 * s for s in targets)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.schema.names == docs.schema.names and sum(len(WORDS.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_shares_above_the_bound_are_shared_again(spark):
    sizes = spark.createDataFrame([("0a", 10), ("0b", 1000), ("0c", 5), ("1", 985)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(sizes).collect()}
    assert got["0a"] == 30 and got["0c"] == 15 and got["0b"] + got["1"] == pytest.approx(1955) and got["1"] / got["0b"] == pytest.approx(2.5)


def test_curriculum_falls_and_rises(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "concat('s', id % 3) AS source")
    order = [r.source for r in mixing.mix(docs).collect()]
    early, late = order[: len(order) // 4], order[-len(order) // 4 :]
    assert early.count("s0") > 1.3 * late.count("s0") and late.count("s2") > 1.5 * early.count("s2")


TEXTS = ["", " ", "a  b", " a", "a ", "a\n b", "it's I'LL don't", "Éá b ́c", "x.\ny z,\nq", "<|endoftext|> a", "İ ΣΣ σ", "\x85 a b\x0b c", "don.\nt 's", "a" * 500, "Hello, World! 123 ,,, ok?!"]


@pytest.mark.parametrize(("path", "how"), [(BYTES, "spaced"), (WORDY, "words")])
def test_pieces_do_not_change_ids(path, how):
    library, pieces = Tokenizer.from_file(path), PieceEncoder(path, how)
    library.encode_special_tokens = True
    draw = np.random.default_rng(4)
    texts = TEXTS + ["".join(draw.choice(list(" \n\tabZé'.,1-"), 15)) for _ in range(1500)] + [r[1] or "" for r in odd_rows()]
    for text in texts:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("path", "how"), [(BYTES, "spaced"), (WORDY, "words")])
def test_ids_of_texts_with_added_tokens(path, how):
    library, pieces = Tokenizer.from_file(path), encoder(path, how)
    texts = TEXTS + ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b\n<|startoftext|> c", "<|ENDOFTEXT|> <|endoftext |> x", "<|endoftext|><|endoftext|>"]
    for text in texts:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    for n in (0, 1, 7, 65_536, 70_001):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 700)
    docs = odd_docs(spark)
    library = Tokenizer.from_file(BYTES)
    ids = lambda text: library.encode(text or "", add_special_tokens=False).ids + [0]
    chunks = token_files.write(docs, BYTES)
    got = token_files.read_documents(chunks).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows()), key=lambda i: (i is not None, i))
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got if r.doc_id is not None) == sorted((False, r[0], ids(r[1])) for r in odd_rows() if r[0] is not None)
    index = token_files.read_index(chunks).collect()
    assert sorted(map(str, index)) == sorted(str(r) for r in token_files.read_documents(chunks).drop("ids").collect())
    assert token_files.read_index(token_files.write(docs.limit(0), BYTES)).count() == 0


def test_packing(spark):
    docs = odd_docs(spark)
    library = Tokenizer.from_file(WORDY)
    rows = packing.pack(docs, WORDY, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length & (r.length - 1) == 0 and r.length == len(r.ids) <= 2048 and r.offset == 0 for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert len({(r.sequence_id >> 58, r.length) for r in rows}) == len({r.length for r in rows})
    want, got = defaultdict(int), defaultdict(int)
    for r in odd_rows():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
        want[r[0], n] += n
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert want == got
    assert packing.pack(docs.limit(0), WORDY).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10_000])
def test_lengths(n):
    assert sum(packing.lengths_of(n)) == n and sorted(packing.lengths_of(n), reverse=True) == packing.lengths_of(n)


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><div id="header">Site</div><div class="menu"><a href=x>Home</a></div>
<div id=content><h1>Title {0}</h1><div class="post-body"><p>Some &amp; text {0}&nbsp;here.<p>More   {0}<br>line<div class="ad-box">Buy</div>{1}<p>end <b>bold {0}</b></div>
<div class="comments"><p>nice {0}</p></div></div><form>Name {0}</form><p>Terms apply</p><!-- <p>gone</p> --></body></html>"""


def test_page_text(spark):
    pages = [(k, f"https://h{k % 2}.org/{k}", PAGE.format(k, f"<ul><li>x{k}</li><li>y</li></ul>" if k % 3 else "")) for k in range(12)]
    article = "<body><nav>m</nav><header>site</header><article><header><h1>A</h1></header><p>one<p>two &lt;3</article><aside>s</aside><footer>f</footer>"
    pages += [(100, "http://a.org", article), (100, "http://a.org", article), (101, None, "<p>x"), (102, "bad url", None), (103, "http://a.org", ""), (None, "http://a.org/" + "x" * 50, article + "<p>" * 5000)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("w"), "part": F.lit(2)})
    got = html_text.extract_text(docs).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        if r.page_id is not None and r.page_id < 12:
            middle = f" x{r.page_id} y" if r.page_id % 3 else ""
            assert r.text == f"Title {r.page_id} Some & text {r.page_id} here. More {r.page_id} line{middle} end bold {r.page_id}"
        elif r.page_id in (100, None):
            assert r.text == "A one two <3"
        elif r.page_id in (102, 103):
            assert r.text == ""
    assert html_text.extract_text(docs.limit(0)).count() == 0


def texts_of(spark, pages):
    rows = [(k, "http://one.org/p", page) for k, page in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_mixed_templates_of_a_host(spark):
    inside, beside = "<nav>m</nav><article><h1>A{0}</h1><p>one {0}</article>", "<main><h1>H{0}</h1><p>lead {0}<article><p>body {0}</article></main><footer>f</footer>"
    plain, only = "<nav>m</nav><div class=content><h1>C{0}</h1><p>two {0}</div><footer>f</footer>", "<main><p>three {0}</main>"
    got = texts_of(spark, [t.format(k) for k, t in enumerate([inside, beside, plain, only] * 4)])
    want = ["A{0} one {0}", "H{0} lead {0} body {0}", "C{0} two {0}", "three {0}"]
    assert got == {k: want[k % 4].format(k) for k in range(16)}


@pytest.mark.parametrize("n", [2, 3, 9])
def test_copies_of_a_page_show_no_template(spark, n):
    page = "<div class=menu>m</div><div><h1>A</h1><p>some text</p></div>"
    assert set(texts_of(spark, [page] * n).values()) == {"A some text"}
    assert set(texts_of(spark, [page] * n + ["<div><p>another</p></div>"]).values()) == {"A some text", "another"}


def test_small_blocks_beside_the_text_stay(spark):
    page = "<div class=lead>lead {0}</div><div class=text><h1>A{0}</h1><p>" + "long {0} " * 50 + "</div><div class=sum>end {0}</div><div>Terms</div>"
    got = texts_of(spark, [page.format(k) for k in range(5)])
    assert got == {k: f"lead {k} A{k} " + f"long {k} " * 50 + f"end {k}" for k in range(5)}


def test_words_on_the_whole_page_do_not_empty_it(spark):
    article = "<nav>m</nav><article><h1>A</h1><p>some long text of a page</article><aside class=related><article>teaser</article></aside>"
    pages = [
        f'<html class="cookies-not-set"><body class="single no-sidebar">{article}',
        f'<body><div id=page class="site right-sidebar">{article}<div class=share>s</div></div><p>9 visits',
        '<body><div class="widget"><main class="has-sidebar"><h1>A</h1><p>some long text of a page</main></div>',
        f"<head><title>t</title><script>var a = '<p>no</p>';</script><meta charset=utf-8><nav>m</nav>{article}",
        "<body class=cookies><div class=content><h1>A</h1><p>some long text of a page</div><div class=related><article>teaser</article></div>",
    ]
    assert texts_of(spark, pages) == dict.fromkeys(range(5), "A some long text of a page")


def test_alignment_does_not_depend_on_grouping():
    trees = [html_text.tree(PAGE.format(k, "<p>extra</p>" if k % 2 else "")) for k in range(6)]
    one = None
    for t in trees:
        one = html_text.align(one, t)
    halves = []
    for part in (trees[:3], trees[3:]):
        half = None
        for t in part:
            half = html_text.align(half, t)
        halves.append(half)
    assert html_text.main_paths(one) == html_text.main_paths(html_text.align(*halves))


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    draw = np.random.default_rng(2)
    rows = [(int(k), [float(np.float32(x)) for x in draw.normal(size=24) * (k % 5)]) for k in range(300)]
    rows += [(k, rows[1][1]) for k in range(400, 440)] + [(5, None), (None, rows[2][1]), (600, [float("nan")] * 24), (601, [None] * 24), (700, [1.0, 2.0]), (701, [3.0, 1.0]), (800, []), (rows[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "score": F.lit(3)})
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = [(i, np.floor(np.array(v) * 1024).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = {}
    for q, x in usable:
        if q % 100 == 0:
            scores = sorted((-int(x @ y) if len(x) else 0, i) for i, y in usable if i != q and len(y) == len(x))
            want[q] = [(i, -s) for s, i in scores[:10]]
    assert dict(got) == {q: w for q, w in want.items() if w}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_are_exact():
    a = np.array([[2.0**40, 3.0], [2.0**60, 2.0**60]])
    assert topk.products(a, a).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    assert topk.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.schema.names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    clear, unique, apart, mixed, packed = (k.collect() for k in kept[1:])
    assert all(k.schema.names == names for k in kept[1:5])
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clear}
    judged = {r.doc_id for r in language.predict(docs, language.train(docs)).where("ambiguous OR lang_pred = 'und'").select("row.doc_id").collect()}
    assert gone == judged and len(gone) < 0.02 * docs.count()
    first = {}
    for r in sorted(clear, key=lambda r: r.doc_id):
        first.setdefault(SPACES.sub(" ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(first.values())
    groups = near_components([(r.doc_id, r.text) for r in unique], 5)
    assert sorted(r.doc_id for r in apart) == sorted(set(groups.values()))
    taken = {r.doc_id: r.taken for r in mixing.plan_mix(kept[3]).collect()}
    words = defaultdict(int)
    for r in mixed:
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if n}
    library, n_ids = Tokenizer.from_file(WORDY), defaultdict(int)
    for r in packed:
        n_ids[r.doc_id] += r.length
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id, r.text] += 1
    assert n_ids == {i: c * (len(library.encode(t, add_special_tokens=False).ids) + 1) for (i, t), c in copies.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pieces_of_a_large_vocabulary_are_encoded_once():
    from flowtables.llm import encoding

    made = []
    pieces = encoding._Pieces(lambda piece: made.append(piece) or piece.encode())
    for _ in range(2):
        assert all(pieces[str(k)] == str(k).encode() for k in range(450_000))
    assert len(made) == 450_000


@pytest.mark.parametrize("name, how", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_workers_hold_what_they_are_told(name, how):
    """The second tokenizer is loaded for the first text that needs it; few remembered pieces give the same ids."""
    path = public_tokenizers.path(name)
    few, many = (PieceEncoder(path, how, added=True, remembered=n) for n in (8, 100_000))
    texts = [r[1] or "" for r in odd_rows()]
    assert [few.encode(t) for t in texts] == [many.encode(t) for t in texts]
    assert max(len(x) for kind in (few.pieces, few.bare, few.careful) for x in (kind, kind.older)) <= 8 < len(many.pieces)
    assert "unchanged" not in vars(few)
    marked = next(t.content for t in few.tokenizer.get_added_tokens_decoder().values() if t.content)
    assert few.encode(f"a {marked} b") == many.encode(f"a {marked} b") and "unchanged" in vars(few)
