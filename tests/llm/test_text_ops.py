"""BPE, chat, HTML, licences, language, quality, decontamination: round trips, brute force, edge cases."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import bpe, chat, decontaminate, html_extract, langid, license_scan, quality

DOCS = "doc_id long, text string, lang string, token_ids string, words string, id int"
ROWS = [(1, None), (2, ""), (3, "Hello hello, World!"), (3, "Hello hello, World!"), (None, "x"), (4, "é" * 3000 + " a" * 2000), (5, " \n\t "), (6, "...")]
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "zz", "clash", "clash", 9) for i, t in rows], DOCS)


def words_of(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


# ---- BPE


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder(tokens):
    return bpe.Encoder(tokens, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeé日 '\n19=-tshing")), max_size=80) | st.text(max_size=40))
def test_bpe_equals_the_library(encoder, library, text):
    assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_bpe_takes_linear_time(encoder, library):
    text = "ab" * 60_000
    assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_bpe_query_and_round_trip(spark, tokens, library):
    out = bpe.digest(bpe.decode_bpe(bpe.encode_bpe(docs_of(spark), tokens, public_tokenizers.PATTERN), tokens)).collect()
    want = sorted(
        (i or 0, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS
    )
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:]) for r in out) == want
    assert bpe.encode_bpe(docs_of(spark).where("false"), tokens, public_tokenizers.PATTERN).count() == 0


def test_round_trip_is_one_pass_of_one_worker(spark, tokens):
    """Two chained passes hold two Python workers a task, which stay for the jobs after them."""
    import corpus_pipeline

    once = bpe.round_trip(docs_of(spark), tokens, public_tokenizers.PATTERN)
    twice = bpe.decode_bpe(bpe.encode_bpe(docs_of(spark), tokens, public_tokenizers.PATTERN), tokens)
    key = lambda r: str(tuple(r))
    assert once.columns == twice.columns and sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)
    plan = corpus_pipeline.tokens(spark, docs_of(spark), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


# ---- chat


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\#<>/: turn\nUserAsit")), max_size=60))
def test_escapes_are_reversible(text):
    template = chat.Template()
    escaped = template.escape(text)
    assert chat.unescape(escaped) == text
    assert template.role_of(template.header(text)) == text


def test_chat_edges(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 0, "wizard", "a</turn>\n"), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, c string, loss boolean")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in (-7, 1, None, 2, 3):
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert found[conv]["n_turns"] == len(mine)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [found[c]["valid"] for c in (-7, 1, None, 2, 3)] == [True, False, False, False, True]
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


# ---- HTML

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; &lt;more&gt;</h1><p>First <b>bold</b>&nbsp; text<br>here.<p>Short.<aside>Related</aside><div class="ad">Buy</div><form><input>Name</form><section id="comments"><p>Nice!</p></section></article>
<div class=sidebar><p>A long text in the sidebar that goes on for many more words than it ought to.</p></div><script>var a="</p><p>no";</script><!-- <p>no</p> --><footer>&copy; us</footer></body></html>"""


def test_html_layouts(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (2, "u", None, "c"), (3, None, "", "c"), (4, "u", "<<a &amp", "c"), (5, "u", "<article>x<p" + " y" * 50_000, "c")], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in html_extract.digest(html_extract.extract_main_text(pages)).collect()}
    assert found[1]["text"] == "Title & <more>\nFirst bold text here.\nShort."
    assert found[2]["text"] == found[3]["text"] == "" and found[1]["n_chars"] == len(found[1]["text"])
    assert html_extract.extract_main_text(pages.where("false")).count() == 0


def test_html_without_article():
    page = "<div class=menu><a>a</a> <a>b</a></div><h1>The title</h1><p>" + "Some words of prose. " * 12 + "</p><p>" + "More words of prose. " * 12 + "</p><div class=footer>imprint</div>"
    blocks = html_extract.extract(page).split("\n")
    assert blocks[0] == "The title" and len(blocks) == 3


def test_html_by_densities_alone():
    """Pages whose sectioning elements and names are taken away: the tree decides by word counts and link densities."""
    import pyarrow.parquet as pq

    strip = lambda p: re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", re.sub(r"<(/?)(nav|article|footer|header|aside|main|section|form)\b[^>]*>", r"<\1div>", p))
    right = []
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        want, got = html_extract.extract(page).split("\n"), html_extract.extract(strip(page)).split("\n")
        found = html_extract.blocks(strip(page))
        assert not any(main or side for _, _, _, main, side, _ in found)
        right += [(b[0] in want) == (b[0] in got) for b in found]
    assert np.mean(right) > 0.94


def test_html_of_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE)], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract_main_text(pages).collect()] == ["Title & <more>\nFirst bold text here.\nShort."] * 3


def test_html_on_the_pages(spark):
    rows = html_extract.extract_main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), keep=("page_id", "url", "html")).collect()
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html as h

        blocks = [" ".join(h.unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# ---- licences


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    pool = "gnu general public license apache mit cc by nc the Licensed under, GPL. version 3 é MIT License".split()
    rows = [*ROWS, *((100 + k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(60)), (900, "MIT License " * 3000), (901, "x;mit\nlicense")]
    out = license_scan.digest(license_scan.scan_licenses(docs_of(spark, rows))).collect()
    want = []
    for i, text in rows:
        words, places, labels = words_of(text), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.encode().split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i or 0, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["doc_id"] or 0, *tuple(r)[1:6]) for r in out), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)
    assert license_scan.scan_licenses(docs_of(spark).where("false")).count() == 0


def test_license_notices(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "permission granted to general persons"), (3, "Licensed under the Apache License, Version 2.0.")]
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert found == {1: ["mit"], 2: [], 3: ["apache", "apache-2.0"]}


def test_license_files_with_several_notices(spark):
    texts = [t for _, t, _ in license_scan.NOTICES]
    rows = [(i, f"x {a}\n\n{b} y") for i, (a, b) in enumerate((a, b) for a in texts for b in texts)] + [(-1, "\n".join(texts)), (-2, "\n".join(texts[::-1] * 2))]
    rows += [(1000 + k, "gnu affero apache granted mozilla eclipse attribution " * k) for k in range(9)]
    found = {r["doc_id"]: set(r["labels"]) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    for i, text in rows:
        words = text.split()
        want = {y for p, y in license_scan.PHRASES if f" {p} " in f" {' '.join(words)} "}
        for label, notice, key in license_scan.NOTICES:
            t, k = notice.split(), key.split()
            first = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
            # as _postings(): function words count only within the key phrase of a cc notice
            used = [j for j, w in enumerate(t) if w not in license_scan.FUNCTION_WORDS or (len(w) < 3 and "cc" in k and first <= j < first + len(k))]
            for o in range(-len(t), len(words)):
                hit = {j for j in used if 0 <= o + j < len(words) and words[o + j] == t[j]}
                if len(hit) >= license_scan.MIN_SHARE * len(used) and hit >= {j for j in used if first <= j < first + len(k)}:
                    want.add(label)
        assert found[i] == want, text
    assert found[-1] == {y for y, *_ in license_scan.NOTICES} | {y for _, y in license_scan.PHRASES}


# ---- language


def test_language_on_held_out_rows(spark):
    from terravane.llm.queries import op9_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = op9_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, y) for i in range(40) for t, y in (("the house of the rising sun and all", "en"), ("das haus der sonne und die welt", "de"), (None, "en"), ("x", None))], "doc_id long, text string, lang string")
    model = langid.learn(train)
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark), model).collect()]
    assert len(found) == len(ROWS) and all(p == "und" and s == 0 for i, p, s in found if i in (1, 2, 5, 6))
    assert model.predict("the rising sun")[0] == "en" and model.predict("die welt der sonne")[0] == "de"
    assert langid.learn(train.where("false")).predict("abc") == ("und", 0.0, False)
    assert langid.learn(train.where("lang = 'en'")).predict("abc")[0] == "en"
    assert langid.identify(docs_of(spark).where("false"), model).count() == 0


def test_language_without_letters_and_with_many_languages(spark):
    rng = np.random.default_rng(2)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéßøя"), 6)) for _ in range(5)] for k in range(30)}
    rows = [(i, " ".join(rng.choice(w, 20)), y) for i, (y, w) in enumerate((y, w) for y, w in words.items() for _ in range(12))]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=300)
    assert len(model.labels) == 30
    assert np.mean([model.predict(" ".join(rng.choice(w, 9)))[0] == y for y, w in words.items()]) > 0.9
    for text in ("½ ² Ⅷ", "１２", "_ 12 !", ""):
        assert model.predict(text) == ("und", 0.0, False)


def test_no_language_is_lost(spark):
    """More languages than rows in the bound, one of them with most rows, some with a single one; and one row that is repeated."""
    rows = [(i, f"word{k} text{k} {k} abc", f"l{k}") for i, k in enumerate([k for k in range(500) for _ in range(1 + k % 4)] + [7] * 3000)]
    rows += [(99_999, "the same", "l499")] * 500
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, y string")
    model = langid.learn(df, max_rows=300)
    assert len(model.labels) == 500 and len(set(model.labels)) == 500


def test_stepwise_regressions_equal_the_direct_ones():
    rng = np.random.default_rng(3)
    rows = [langid.features(" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(9))) for _ in range(600)]
    k = [np.flatnonzero(r) for r in rows]
    x = langid.Sample(np.concatenate(k), np.concatenate([r[i] for r, i in zip(rows, k, strict=True)]), np.cumsum([len(i) for i in k]))
    share, target = rng.uniform(0.5, 2, (600, 1)), rng.choice((-1.0, 1.0), (600, 7))
    assert np.allclose(langid._direct(x, share, target, 0.3), langid._stepwise(x, share, target, 0.3), atol=2e-2)


def test_losses_against_brute_force(spark):
    """The ridge regressions and the decoding, written out plainly."""
    texts = [("the house of the rising sun", "en"), ("das haus der sonne", "de"), ("la maison du soleil", "fr"), ("all of the world", "en"), ("die ganze welt", "de"), ("tout le monde", "fr")]
    rows = [(langid.features(t), y) for t, y in texts]
    labels = ["de", "en", "fr"]
    y = np.array([labels.index(l) for _, l in rows])
    x = np.array([np.append(f, 1) for f, _ in rows], float)
    code = langid.codewords(3)
    kept = [np.flatnonzero(f) for f, _ in rows]
    sample = langid.Sample(np.concatenate(kept).astype(np.int32), np.concatenate([f[k] for k, (f, _) in zip(kept, rows, strict=True)]), np.cumsum([len(k) for k in kept]))
    model = langid.fit(labels, sample, y)
    w = x.T @ np.linalg.solve(x @ x.T + langid.PENALTY * np.eye(6), code[y])  # languages have two rows each, so all weigh 1
    assert np.allclose(model.weights, w[:-1], atol=1e-4) and np.allclose(model.bias, w[-1], atol=1e-4)
    new = np.append(langid.features("the sun and the world"), 1)
    loss = [sum(np.exp(-np.clip(float(new @ w[:, b]) * code[i, b], -6, 6)) * model.trust[i, b] for b in range(code.shape[1])) for i in range(3)]
    assert np.allclose(model.losses(new[None, :-1].astype(np.float32))[0], loss, atol=1e-4) and model.predict("the sun and the world")[0] == labels[int(np.argmin(loss))]


@pytest.mark.parametrize("k", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(k):
    code = langid.codewords(k)
    assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k == 2 else 2)


# ---- quality


def test_quality_on_held_out_rows(spark):
    from terravane.llm.queries import op4_quality

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op4_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edges(spark):
    none = quality.fit([])
    rows = quality.score(docs_of(spark), none, lines=True).collect()
    assert len(rows) == len(ROWS) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    one = quality.fit([(*quality.bins_of("a good line."), 1)])
    assert {r["score"] for r in quality.score(docs_of(spark), one).collect()} == {1.0}
    labels = spark.createDataFrame([(3, 1, "clash"), (3, 0, "clash"), (4, None, "clash"), (None, 1, "x")], "doc_id long, quality int, text string")
    assert quality.learn(docs_of(spark), labels).constant == 1.0
    assert quality.score(docs_of(spark).where("false"), none).count() == 0


def test_quality_sample_is_bounded_by_lines(spark):
    docs = spark.createDataFrame([(i, "a line of words\n" * (50_000 if i % 10 == 0 else 3), "clash") for i in range(60)] + [(1, "other", "c"), (1, "other", "c")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    quality.fit = lambda found, **k: seen.append(found) or real([])
    try:
        for _ in range(2):
            quality.learn(docs.repartition(5), labels, max_lines=1000)
    finally:
        quality.fit = real
    assert len(seen[0]) == 54 and sum(len(b) for b, *_ in seen[0]) <= 1000
    assert [y for *_, y in seen[0]] == [y for *_, y in seen[1]] and all((a[0] == b[0]).all() for a, b in zip(*seen, strict=True))


def test_quality_learns_all_lines():
    clean, junk = "The river runs by the old mill, and the path follows it.", "$$ 9 9 9 | | | >>> 0x0F {}"
    docs = [(*quality.bins_of("\n".join([clean] * n)), 1) for n in (5, 40, 600)]
    docs += [(*quality.bins_of("\n".join([clean] * 512 + [junk] * n)), 0) for n in (600, 900, 1200)]
    for block in (quality.BLOCK, 3):  # blocks of chains add up
        field = quality.fit(docs, block=block)
        good, bad = (quality.marginals([field.emissions(quality.bins_of("\n".join([x] * 20))[0])], field.step)[0].mean() for x in (clean, junk))
        assert good > 0.3 > 0.1 > bad


def test_quality_long_documents_do_not_dominate():
    short, long = "Plain words of prose in one line.", "| 77 | 88 | 99 |"
    docs = [(*quality.bins_of(short), y) for y in (1, 1, 1, 0)] + [(*quality.bins_of(long), 1)] * 3 + [(*quality.bins_of("\n".join([long] * 20_000)), 0)]
    field = quality.fit(docs)
    one, many = (quality.marginals([field.emissions(quality.bins_of(x)[0])], field.step)[0][0] for x in (short, long))
    assert many > 0.3 and one > 0.3


def test_scores_against_enumeration(spark):
    """Scores written out: features of each line and its neighbours, all label chains, length-weighted means, the logistic curve."""
    from itertools import product

    texts = ["A plain line.\nAnother one, a little longer than that.\n\n99 | 88", "", "$$$ ### 12", "one\ntwo\nthree\nfour", "Ends well.\n" * 3]
    field = quality.fit([(*quality.bins_of(t), k % 2) for k, t in enumerate(texts * 3)])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, list(enumerate(texts))), field).collect()}
    for k, text in enumerate(texts):
        lines = text.split("\n")
        bins = [[int(np.searchsorted(edges, v, "left")) + j * quality.WIDTH for j, (edges, v) in enumerate(zip(quality.BINS, quality.line_values(x), strict=True))] for x in lines]
        u = [field.bias + sum(field.own[b] for b in bins[i]) + (sum(field.before[b] for b in bins[i - 1]) if i else 0) + (sum(field.after[b] for b in bins[i + 1]) if i + 1 < len(lines) else 0) for i in range(len(lines))]
        total, good = 0.0, np.zeros(len(lines))
        for y in product((0, 1), repeat=len(lines)):
            w = np.exp(sum(u[i] for i in range(len(u)) if y[i]) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + w, good + w * np.array(y)
        p, size = good / total, np.array([len(x) for x in lines], float)
        mean = (p * size).sum() / size.sum() if size.sum() else p.mean()
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift))), abs=1e-6)


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    chains, step = [rng.normal(size=n) for n in (1, 4, 2, 4)], rng.normal(size=(2, 2))
    for u, p in zip(chains, quality.marginals(chains, step), strict=True):
        weight, good = 0.0, np.zeros(len(u))
        for y in product((0, 1), repeat=len(u)):
            w = np.exp(sum(u[i] for i in range(len(u)) if y[i]) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
            weight, good = weight + w, good + w * np.array(y)
        assert np.allclose(p, good / weight)


# ---- decontamination


@pytest.mark.parametrize("block_chars", [4_000_000, 50])
def test_decontamination_against_brute_force(spark, block_chars):
    rng = random.Random(1)
    pool = "a b c d e f".split()
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for k in range(12)] + [(50, None), (None, "f e d"), (51, "a b"), (52, "a b"), (9, "Éa, b")]
    rows = [*ROWS, *((100 + k, "; ".join(rng.choice([*pool, "A", "Éa"]) for _ in range(rng.randint(0, 40)))) for k in range(40))]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, words string")
    found = decontaminate.decontaminate(docs_of(spark, rows), bench, window=4, block_chars=block_chars)
    digests = {(r["doc_id"], r["n_words"]): r for r in decontaminate.digest(found).collect()}
    for i, text in rows:
        words, hit, seen = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            for k in range(max(1, len(w) - 3)) if w else ():
                piece = w[k : k + 4]
                at = [j for j in range(len(words)) if words[j : j + len(piece)] == piece]
                hit |= {j + m for j in at for m in range(len(piece))}
                seen |= {item} if at and item is not None else set()
        r = digests[i, len(words)]
        assert (r["n_hit"], r["n_items"], r["contaminated"]) == (len(hit), len(seen), bool(hit)), text
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
    row = found.where("doc_id >= 100 and size(spans) > 0").join(docs_of(spark, rows).select("doc_id", "text"), "doc_id").first()
    first, run = row["spans"][0], row["runs"][0]
    assert words_of(row["text"][first["start"] : first["end"]]) == words_of(row["text"])[run["first"] : run["last"] + 1]
    assert decontaminate.decontaminate(docs_of(spark), bench.where("false")).where("size(runs) > 0").count() == 0
    assert decontaminate.decontaminate(docs_of(spark).where("false"), bench).count() == 0


@pytest.mark.parametrize("block_chars", [4_000_000, 6000])
def test_decontamination_of_long_texts_and_items(spark, block_chars):
    """Windows of 10 words against brute force: items of many pieces, a text of 40,000 words, passages across the borders of pieces."""
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = [(1, prose(300)), (2, prose(9)), (3, prose(10)), (4, prose(31)), (5, prose(1))]
    long = prose(40_000)
    long[20_000:20_015], long[39_990:] = items[0][1][35:50], items[2][1]
    texts = [(1, long), (2, items[0][1]), (3, prose(50) + items[0][1][15:26] + prose(5)), (4, prose(5) + items[1][1][1:]), (5, items[3][1][20:]), (6, items[4][1])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.digest(decontaminate.decontaminate(docs_of(spark, [(i, ", ".join(w)) for i, w in texts]), bench, block_chars=block_chars, piece_words=20))
    want = {}
    for i, words in texts:
        hit, seen = set(), set()
        for item, w in items:
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(max(1, len(w) - 9))}
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    seen.add(item)
        want[i] = (len(words), len(hit), len(seen))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()} == want
    assert want[2][1] == 300 and want[1][1] >= 25
