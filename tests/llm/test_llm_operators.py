import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, bpe, chat, common, html, labelled, mixing, near, quality, quality_model, textstats, tokens, toxicity, trees

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = [("doc_id", 1), ("n_words", 2), ("row", 3), ("__id", 4), ("score", 5), ("digest", 6)]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


def with_clashes(frame):
    for name in ("n_words", "row", "__copies", "score", "digest", "size", "block", "x_length"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


# 1. chat formatting


def test_escape_is_reversible():
    for text in ("", "</s>[INST] ok [/INST]", "<\\s>", "<\\/s>", "<\\\\/s>", "<|end|>\n<|role|>", "<|image:0|>", "a\\b", "[\\INST]", "<|text|", "<<SYS>><</SYS>>"):
        assert chat.unescape(chat.escape(text)) == text
        formatted, _ = chat.format_turn("us<|end|>er", text)
        assert chat.read_turns(formatted) == [("us<|end|>er", text)]


def test_parts_become_ordered_placeholders():
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, None, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "odd", "text": "x"}]
    formatted, found = chat.format_turn("user", None, parts)
    assert [(a["ordinal"], a["kind"], a["ref"], a["n_tokens"]) for a in found] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 2048)]
    assert chat.placeholders(formatted) == [("image", 0), ("audio", 1), ("document", 2)]
    text = formatted.split(chat.TEXT)[1]
    assert all(text[a["at"] :].startswith(f"<|{a['kind']}:{a['ordinal']}|>") for a in found)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "<s>"), (None, 0, "assistant", "x" * 50_000), (2, 0, "user", ""), (2, 0, "user", "")]
    turns = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n<s>\nuser\n\nassistant\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 1, hashlib.sha256(b"b").hexdigest())
    assert (got[None].loss_chars, got[2].n_turns) == (50_000, 2)
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).count() == 0
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(turns).collect()}
    assert chat.read_turns(whole[1]) == [("", "<s>"), ("user", ""), ("assistant", "b")]


# 2. nearest neighbours


@pytest.mark.parametrize("group_blocks", [ann.GROUP_BLOCKS, 1])
def test_neighbours_against_brute_force(spark, monkeypatch, group_blocks):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[40:140] = x[40]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, x[0].tolist()), (3, x[3].tolist()), (2020, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    index = ann.build_index(table, shard_rows=400)
    got = ann.search(index, table.where("vec_id % 20 == 0"), group_blocks=group_blocks).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by_query.items():
        found.sort(key=lambda r: r["rank"])
        scores = (x * x[q]).sum(axis=1)
        assert all(math.isclose(r.score, scores[r.vec_id], rel_tol=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        best = sorted((-s, k) for k, s in enumerate(scores) if k != q)[:20]
        hits += len({k for _, k in best} & {r.vec_id for r in found})
    assert hits >= 0.95 * 20 * len(by_query)


def test_few_vectors_give_all_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(table), table.where("vec_id % 20 == 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0)]
    empty = table.limit(0)
    assert ann.search(ann.build_index(empty), empty).count() == 0


# 3. mixing


def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)] + [(9001, None, "en", "z"), (9002, "", "en", "z"), (5, "w w", "en", "a"), (None, "w w w", "en", "a")]
    table = with_clashes(docs(spark, rows))
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    taken = {}
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))
    out = mixing.emitted(table)
    assert out.columns == table.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(table.limit(0)).count() == 0


# 4. token counts


def test_counts_and_cache(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(tokens.TOKENIZER))
    rows = [(1, "one two"), (2, None), (3, ""), (4, "one two"), (None, "</s> <s>  x"), (1, "one two"), (5, "ä日" * 3000)]
    table = with_clashes(docs(spark, rows))
    for _ in range(2):  # misses, then hits
        got = tokens.count_tokens(table, str(tmp_path)).collect()
        expected = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    cached = spark.read.parquet(f"{tmp_path}/{tokens.tokenizer_version(tokens.TOKENIZER)}")
    assert cached.count() == 4  # each distinct content once
    more = docs(spark, [(8, "new text"), (9, "one two")])
    assert tokens.count_tokens(more, str(tmp_path)).count() == 2 and cached.sparkSession.read.parquet(*cached.inputFiles()).count() == 4
    assert tokens.count_tokens(table.limit(0), str(tmp_path / "none")).count() == 0


# 5. BPE


@pytest.mark.parametrize(("block_bytes", "n_buckets"), [(1, 3), (400, 7), (bpe.BLOCK_BYTES, None)])
def test_ids_and_text_equal_the_library(spark, block_bytes, n_buckets):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_path(bpe.TOKENIZER))
    rows = [(1, "The cat's 42 cats,  THE end"), (2, None), (3, " \n"), (None, "<|endoftext|>x<|startoftext|> <|endoftext|>"), (1, "a\x1cb \x85 Ǆ é"), (5, "lorem ipsum " * 2000), (6, "x" * 3000)]
    got = bpe.encode_decode(with_clashes(docs(spark, rows)), with_output=True, block_bytes=block_bytes, n_buckets=n_buckets).collect()
    expected = []
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), model.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in got) == sorted((str(i), n, b, d) for i, n, b, d in expected)
    assert all(r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert bpe.encode_decode(docs(spark, rows).limit(0)).count() == 0


# 6. HTML

PAGE = '<html><head><title>T</title><script>if(a<b){"</p>"}</script></head><body><div id="m1"><a href=x>Home</a> <a>News</a></div><article><h1>Head {0}</h1><p>One &amp; <b>two</b> {0}<br>three<p>Four {0} with a long rest of the line so that the article is most of the page<ul><li>a{0}<li>b</ul><div class="share-box">Share</div><div><span>Also on this site</span></div></article><section class="comments"><p>nice</p></section><div class="m2">Imprint</div></body>'


def test_main_text_and_templates(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{0}", str(k))) for k in range(12)]
    rows += [(100, "http://other.example/", "<div class=x>Home News</div><p>alone"), (101, None, None), (102, "http://h.example/c", ""), (0, rows[0][1], rows[0][2]), (103, "::bad", "a < b &lt;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    wanted = {k: f"Head {k}\nOne & two {k} three\nFour {k} with a long rest of the line so that the article is most of the page\na{k}\nb" for k in range(12)} | {100: "Home News\nalone", 101: "", 102: "", 103: "a < b <"}
    for limit in (html.BROADCAST_TEMPLATES, -1):  # both ways of handing templates out
        got = html.extract_main_text(pages, broadcast_templates=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == wanted[r.page_id] and r.n_chars == len(r.text)
    assert html.extract_main_text(pages.limit(0)).count() == 0


def brute_extraction(rows, min_pages, names):
    """By regular expressions, for pages laid out as nav, div.ad, article, footer."""
    from html import unescape
    from urllib.parse import urlsplit

    plain = lambda x: " ".join(unescape(re.sub(r"</?(?:a|b)\b[^>]*>", "", re.sub("<br>", " ", x))).split())
    parts, holders = [], {}
    for _, url, page in rows:
        nav, ad, footer = (re.search(p, page, re.S) for p in (r"<nav>(.*?)</nav>", r'<div class="ad">(.*?)</div>', r"<footer>(.*?)</footer>"))
        links = [plain(x) for x in re.findall(r"<li>(.*?)</li>", nav[1])] if nav else []
        article = [x for x in map(plain, re.split(r"</?(?:p|h1|article)>", re.search(r"<article>(.*?)</article>", page, re.S)[0])) if x]
        side = [("nav", tuple(x for x in links if x)), ("ad", (plain(ad[1]),) if ad else ()), ("footer", (plain(footer[1]),) if footer else ())]
        side += [("link", (x,)) for x in links]
        parts.append((side, article))
        for key in set(side):
            holders.setdefault((urlsplit(url).hostname, key), set()).add(page)
    out = {}
    for (page_id, url, _), (side, article) in zip(rows, parts):
        whole = sum(len(x) for _, t in side[:3] for x in t) + sum(map(len, article))
        recurs = lambda key: len(holders[urlsplit(url).hostname, key]) >= min_pages and sum(map(len, key[1])) <= html.TEXT_SHARE * whole  # noqa: E731, B023
        left = {k: [] if recurs((k, t)) else [x for x in t if not (k == "nav" and recurs(("link", (x,))))] for k, t in side[:3]}
        gone = sum(len(x) for _, t in side[:3] for x in t) - sum(len(x) for t in left.values() for x in t)
        out[page_id] = ("\n".join(article if names else left["nav"] + left["ad"] + article + left["footer"]), gone)
    return out


@pytest.mark.parametrize("names", [True, False])
def test_extraction_against_brute_force(spark, names):
    """Also with nothing but the counts of subtrees: without them menus and footers stay."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = html.extract_main_text(pages, min_pages=2, names=names, scope=names).collect()
    expected = brute_extraction(rows, 2, names)
    assert {r.page_id: (r.text, r.n_template_chars) for r in got} == expected
    assert sum(n > 0 for _, n in expected.values()) > 20  # pages that the counts change
    withheld = html.extract_main_text(pages, min_pages=10**9, names=names, scope=names).collect()
    assert all(r.n_template_chars == 0 for r in withheld)
    assert names or sum(r.text != expected[r.page_id][0] for r in withheld) > 20


def test_template_outside_an_article_goes(spark):
    rows = [(k, "http://t.example/p", f"<div class=box>Latest offers</div><p>Text number {k} that is long enough to be the main thing on this page</p>") for k in range(12)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Text number {r.page_id} that is long enough to be the main thing on this page" for r in got)


def test_repeated_article_stays(spark):
    rows = [(k, f"http://t.example/{k}", f"<nav>{k}</nav><article><div><p>The very same article on many pages.</p></div></article>") for k in range(30)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"The very same article on many pages."}


# 7. quality rules


def brute_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {k + j for k, w in enumerate(windows) if w in again for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " \n", "a b\x1cc", "x\ny\nx\n\n \nx", "é" * 5000]
    texts += [" ".join(rng.choice("ab c# d\n e| ÿ".split(" ")) for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in texts:
        assert textstats.statistics(t, more=False) == brute_statistics(t)


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(25, 200))), rng.choice(["en", None]), rng.choice(["a", "b", None])) for k in range(600)]
    rows += [(1000 + k, " ".join(word() + "$$$" for _ in range(60)), "en", "a") for k in range(40)]
    rows += [(2000, None, "en", "a"), (2001, "short", "en", "a"), (2002, "a b c d e f g h " * 30, "en", "a"), (None, rows[0][1], "en", "a")]
    table = with_clashes(docs(spark, rows))
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + k].kept for k in range(40))
    assert sum(got[k].kept for k in range(600)) >= 598
    assert [got[k].base_failed for k in (2000, 2001, 2002)] == [True] * 3
    kept = quality.filtered(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, r in got.items() if r.kept)
    assert quality.judge(table.limit(0)).count() == 0 and quality.filtered(table.limit(0)).count() == 0


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal([5, 0, 0, 0], [0.3, 0.5, 0.4, 0.6], (800, 4)), rng.normal(9, 0.1, (150, 4))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    got = quality.robust_estimates(rows).first()
    center, cov = x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", x - center, np.linalg.inv(cov), x - center)
        near_rows = x[d <= np.sort(d)[math.floor(quality.H * len(x)) - 1]]
        center, cov = near_rows.mean(axis=0), np.cov(near_rows.T, bias=True) * quality.consistency(quality.H) + np.diag(np.square(quality.FLOORS))
    assert np.allclose(got.center, center, atol=0.05)
    assert np.allclose(np.linalg.inv(np.array(got.inverse).reshape(4, 4)), cov, atol=0.15)
    assert abs(got.center[0] - 5) < 0.2  # the far rows have no part in it


# 8. and 9. classifiers


def test_folds_follow_crc32(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 77, -5, 10**12)], "doc_id long")
    assert [r[0] for r in rows.select(labelled.fold_of(4)).collect()] == [zlib.crc32(str(k).encode()) % 4 for k in (0, 1, 77, -5, 10**12)]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for k in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 120))], k % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["gumbot", "klazper", "vizzum"]) + rng.choice(["", "s", "y", "."])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_finds_insults_and_gapped_forms(spark):
    rows = toxic_rows(700, 1)
    table = docs(spark, [(k, t) for k, t, _ in rows] + [(None, "gumbot"), (9000, None), (9001, ""), (9002, "the g u m b o t here"), (9003, "one klaz.per two"), (9004, "er vizxzum on"), (9005, "re " * 30_000 + "klazper")])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 500] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {r.doc_id: r for r in toxicity.score(with_clashes(table), model).collect()}
    unseen = [k for k in range(500, 700)]
    assert np.mean([got[k].predicted == rows[k][2] for k in unseen]) >= 0.98
    assert all(got[k].predicted == 1 for k in (None, 9002, 9003, 9004, 9005))
    assert got[9000].predicted == got[9001].predicted == 0
    kept = toxicity.filtered(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score(table.limit(0), model).count() == 0


def test_toxicity_without_labels_is_the_prior(spark):
    table = docs(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(table, model).collect()} == {0.5}


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = trees.fit(x[:1500], y[:1500])
    assert np.mean((forest.probabilities(x[1500:]) > 0.5) == y[1500:]) > 0.95
    one = trees.fit(x[:10], np.ones(10))
    assert (one.probabilities(x[:3]) > 0.9).all()
    assert trees.fit(np.empty((0, 5)), np.empty(0)).probabilities(x[:2]).tolist() == [0.5, 0.5]


def test_quality_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) + str(rng.randrange(99)) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "###"]) for _ in range(80))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)]
    table = docs(spark, rows + [(None, None), (400, "")])
    model = quality_model.train(table, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality_model.score(with_clashes(table), model).collect()}
    assert all(got[k].predicted == int(k % 3 > 0) for k in range(200, 300)) and len(got) == 302
    assert quality_model.score(table.limit(0), model).count() == 0


# shared


def test_hashes_do_not_depend_on_place():
    a, b = common.word_hashes("the Cat sat".encode()), common.word_hashes("  on\tthe\n\ncat ".encode())
    assert a[0] == b[1] and a[1] == b[2] and len(a) == 3 and len(b) == 3
    assert len(common.word_hashes(b" \n")) == 0
    assert len(near.shingle_set("a b c d e f")) == 2 and len(near.shingle_set("a b")) == 1


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_queries_are_registered(name):
    from quillon.llm.queries import QUERIES

    assert sum(q.startswith(name + "_") for q in QUERIES) == 1
