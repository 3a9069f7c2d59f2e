"""Operators on single texts: toxicity, quality rules, site quality, personal data, main text."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import boosting, html_text, pii, quality_rules, recurrent, site_quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, site string, y long, size long"


def rows(n, text, extra=("e", "s", 0, 0)):
    return [(k, text(k), "en", f"s{k % 3}", None, *extra) for k in range(n)]


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net, x, mask, y, w = recurrent.initial(4, 3, 1), rng.normal(size=(5, 6, 4)), (rng.random((5, 6)) > 0.3).astype(float), (rng.random(6) > 0.5).astype(float), np.ones(6)
    _, g = recurrent.gradients(net, x, mask, y, w)
    for k, v in net.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        up, down = ({a: b.copy() for a, b in net.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        slope = (recurrent.gradients(up, x, mask, y, w)[0] - recurrent.gradients(down, x, mask, y, w)[0]) / 2e-5
        assert slope == pytest.approx(g[k][i], abs=1e-7)


def _talk(rng, bad):
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 90))]
    if bad:
        words[rng.randrange(len(words))] = rng.choice(["grumbolt,", "Snivelwort", "snivelling"])
    return " ".join(words)


def test_toxicity_learns_and_keeps_rows(spark):
    rng = random.Random(3)
    label = lambda k: int(k % 4 == 0)
    data = [(k, _talk(rng, label(k)), "en", "s", None, "e", "s", 7, 0) for k in range(900)]
    data += [(900, None, None, None, None, None, None, None, None), (901, "", "en", "s", 0, "e", "s", 7, 0), (None, "snivelwort " * 40, "en", "s", 0, "e", "s", 7, 0), data[4]]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(k, label(k)) for k in range(900)] + [(None, 1), (899, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(data) and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 899 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == bool(label(r.doc_id)) for r in held)
    assert right / len(held) > 0.95
    empty = [r.score for r in scored if not r.text]
    assert len(set(empty)) == 1 and empty[0] < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 1
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), none).count() == 0 and toxicity.score(docs.limit(3), none).select("score").distinct().count() == 1


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        starts = toxicity.windows(n)
        seen = {k for s in starts for k in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= seen


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 3)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    texts += ["", "a", "x\ty z", "a b c d e a b c d e", "a\n\na\n a", "#|é €", "the " * 3000, "one two three four five " * 50]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "e", "s", 0, 0) for k, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None, None)], DOCS)
    out = {r.id: r for r in quality_rules.judge(docs).collect()}
    assert len(out) == len(texts) + 1 and out[None].base_failed and not out[None].kept
    for k, t in enumerate(texts):
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(t), t[:50]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_divergence_rejects_symbols_and_keeps_prose(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(quality_rules.COMMON["en"].split() + ["stone", "river", "walking", "Tower"]) for _ in range(200))
    data = [(k, prose(), "en", "s", 0, "e", "s", 0, 0) for k in range(40)] + [(100, re.sub(" ", "### ", prose()), "en", "s", 0, "e", "s", 0, 0), (101, prose().upper(), "en", "s", 0, "e", "s", 0, 0)]
    kept = {r.id: r.kept for r in quality_rules.judge(spark.createDataFrame(data, DOCS)).collect()}
    assert all(kept[k] for k in range(40)) and not kept[100] and not kept[101]


def test_few_long_words_are_judged_by_their_characters(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(quality_rules.COMMON["en"].split() + ["stone", "river", "walking", "Tower"]) for _ in range(n))
    blob = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(12))
    texts = {k: prose(200) for k in range(40)} | {100: blob, 101: prose(30), 102: " ".join("stonewalking" + c for c in "abcdefghijklmnopqrstuvwxyz")}
    out = {r.id: r for r in quality_rules.judge(spark.createDataFrame([(k, t, "en", "s", 0, "e", "s", 0, 0) for k, t in texts.items()], DOCS)).collect()}
    assert not out[100].base_failed and not out[100].kept and out[100].word_distance is None
    assert out[101].class_distance is None and all(out[k].kept for k in texts if k != 100)


def test_site_quality_shrinks(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["stone", "river", "the", "and", "walking"]) for _ in range(80))
    bad = lambda: "#|# " * 60
    data = [(k, bad() if k % 4 == 0 else good(), "en", "a" if k % 4 == 0 else "b", 0, "e", "s", 0, 0) for k in range(400)] + [(900, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)], "doc_id long, quality int")
    out = {r.id: r for r in site_quality.judge(docs, labels).collect()}
    assert len(out) == 401
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((out[k].score >= 0.5) == (k % 4 > 0) for k in held) / len(held) > 0.97
    assert out[4].host_score < out[1].host_score and 0 <= out[900].score <= 1
    assert site_quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def _plain_base(text):
    """The fixed patterns, written once more without shortcuts."""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0

    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for k, x in enumerate((email, ip, card, phone)) for a, b in x]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    bits = ["4539 1488 0343 6467", "4539148803436467", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "0001.2.3.4", "a.b@c.de", "x@y", "+1 (555) 010-9999", "+49 30 123456", "+1", " ", "é", "\n", "-", "+", "7", "@", ".", "a"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == _plain_base(text), text


def test_pii_adds_and_redacts(spark):
    text = 'é write a.b@c.de or token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" call 2024-05-17'
    data = [(1, text), (1, text), (2, None), (3, ""), (None, "nothing here " * 2000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "e", "s", 0, 0) for i, t in data], DOCS)
    from pyspark.sql import functions as F

    got = docs.select("doc_id", pii.pii(F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    first = got[0]
    base = f"email:8:16"
    assert first.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and first.n_email == 1
    assert first.spans.startswith(base) and ",secret:" in first.spans and "number" not in first.spans
    assert got[0] == got[1] and got[2].spans == got[3].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns and clean.first().text == 'é write <EMAIL> or token = "<SECRET>" call 2024-05-17'
    assert clean.where("text IS NULL").count() == 1 and pii.redact_documents(docs.limit(0)).count() == 0
    assert pii.redact("abcdef", [(0, 1, 3), (1, 2, 4)]) == "a<EMAIL>ef"


def test_spelled_addresses_of_all_forms():
    fitted = pii.model()
    forms = ["jane(AT)example(DOT)com", "jane [at] example [DOT] com", "jane{at}example{dot}com", "jane [at] example.com", "jane(at)example.com", "jane at example dot com"]
    texts = [f"please write {x} about rooms" for x in forms] + ["we met at noon.then we left"]
    found = [[t[a:b] for _, a, b in added] for t, (_, added) in zip(texts, pii.find(texts, fitted), strict=True)]
    assert found == [[x] for x in forms] + [[]]
    rng, bits = random.Random(6), ["a", "b-1", "_x", ".", " ", " at ", "(at)", " [AT] ", "{at", " at", "dot", " dot ", "(DOT)", "é", "at", "]"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.addresses(text) == [m.span() for m in pii.GENERATORS[0][1].finditer(text)], text


def test_boosting_fits_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(x[:1000], y[:1000], trees=40)
    p = trees.probability(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.93
    t = boosting.calibrated_threshold(p, y[1000:], 0.97)
    assert y[1000:][p >= t].mean() >= 0.97
    assert boosting.calibrated_threshold(np.array([0.3]), np.array([0.0])) == 2.0


def test_main_text_of_made_pages():
    trees, rng = html_text.model(), random.Random(77)
    wrong = 0
    for _ in range(60):
        markup = html_text._made_page(rng)
        page = html_text.Page(markup)
        labels = html_text._labels(markup, page)
        wrong += html_text.main_texts([markup], trees)[0] != "\n".join(t for k, t in zip(page.owner, page.text, strict=True) if labels[k])
    assert wrong <= 3


def test_main_text_cases(spark):
    from pyspark.sql import functions as F

    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><div class="ad">Buy this now today.</div><article><h1>Head&amp;line</h1><p><b>One  two\n three.<br><p>Second &quot;paragraph&quot; is here, with words and more words.</p></article><footer>&copy; host</footer></body></html>'
    df = spark.createDataFrame([(1, page), (1, page), (2, None), (3, ""), (4, "plain  text")], "page_id long, html string")
    out = [r.t for r in df.select(html_text.main_text(F.col("html")).alias("t")).collect()]
    assert out == ['Head&line\nOne two three.\nSecond "paragraph" is here, with words and more words.'] * 2 + ["", "", "plain text"]


def test_silent_elements_do_not_take_the_page():
    body = "<article><h1>Head line</h1><p>First paragraph, with words and more words.</p>{}<p>Second paragraph is here, with yet more words.</p></article>"
    whole = "Head line\nFirst paragraph, with words and more words.\nSecond paragraph is here, with yet more words."
    pages = ["<html><head><title>t</title><meta charset=x><style>p {}</style><body>" + body.format(""), "<head><title>t</title>" + body.format("")]
    silent = ('<svg width="1"/>', "<math/>", "<svg/><svg><text>x</text></svg>", "<iframe/>", '<iframe src="a"/><iframe>x</iframe>', "<object>", "<button>", "<svg>", "<SVG><text>x</text></Svg >", "<script>x</script>", "<select><option>x</select>")
    pages += ["<html><head><title>t</title></head><body>" + body.format(x) for x in silent]
    for page, text in zip(pages, html_text.main_texts(pages, html_text.model()), strict=True):
        assert text == whole, page
    assert html_text.Page("<p>a</p><script>b <p>c</p>").text == html_text.Page("<p>a</p><textarea>b").text == ["a"]


def test_decoding_never_contradicts():
    page = html_text.Page("<div><div><p>a</p></div></div><div><p>b</p></div>")
    for seed in range(50):
        logit = np.random.default_rng(seed).normal(size=len(page.tag))
        chosen = html_text.decode(page, logit)
        assert all(chosen[page.parent[k]] or not chosen[k] for k in range(1, len(chosen)))
