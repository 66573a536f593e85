import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, pages_of
from veriskill.llm import lang_id, piece_codec, quality_fm
from veriskill.llm.html_extract import extract_text, main_text

PAGE = """<html><head><title>x</title></head><body class="home"><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First <b>para</b>.<p class="ad">Buy<p>Second&nbsp;para<br>goes on &lt;here&gt;</p><ul><li>One</li><li>Two</ul><form><input>subscribe</form>
<aside>Side</aside><script>if (a < b) { x("</p>") }</script><!-- no <p>text</p> --><section class="comments"><article>Nice post</article></section></article></main><div id="sidebar">links</div><footer>c</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert main_text(PAGE) == "Title & more\n\nFirst para.\n\nSecond para goes on <here>\n\nOne\n\nTwo"


def test_main_text_by_line_blocks():
    long = "Long sentences of text that go on. " * 5
    html = f"<body><div><a href=x>Home</a> <a>News</a></div><div>{long}</div><div>Short.</div><p>{long}</p><div><a>Terms of use</a></div></body>"
    assert main_text(html) == "\n\n".join((long.strip(), "Short.", long.strip()))


def test_main_text_of_a_held_article():
    html = "<body><div class=top>Site name</div><div id='post-content'><div><p>One.</p></div><p>Two.</p><div class=share>Share</div><p>Three.</div><p>Imprint</p></body>"
    assert main_text(html) == "One.\n\nTwo.\n\nThree."


def test_main_text_is_whole():
    one, two = ("One long sentence of the text goes on and on. " * 4).strip(), ("Another long sentence follows it here and there. " * 4).strip()
    for name in ("post-meta", "article-title", "entry-header", "story-date"):
        assert main_text(f"<body><div class='{name}'>By X</div><div class='text'><p>{one}</p><p>{two}</p></div>").endswith(f"{one}\n\n{two}")
    assert main_text(f"<body><p>Menu</p><article><p>{one}</p></article><article><p>{two}</p></article>") == f"{one}\n\n{two}"
    for tag, name in (("article", "post has-comments"), ("div", "content no-sidebar"), ("div", "entry social"), ("section", "widget")):
        page = f"<body><div>Site</div><{tag} class='{name}'><p>{one}</p><p>{two}</p><div class='share'>Share</div></{tag}>"
        assert main_text(page).endswith(f"{one}\n\n{two}") and "Share" not in main_text(page)
    links = "<ul>" + "<li><a href=x>Some other page of it</a></li>" * 6 + "</ul>"
    assert main_text(f"<body><div class='content'>{links}<h2>Title</h2><p>{one}</p><p>{two}</p><p>End.</p>{links}</div>") == f"Title\n\n{one}\n\n{two}\n\nEnd."
    assert main_text(f"<body><div class='sidebar'>Short</div><div style='display:none' class='ad'>{one} {one}</div><p>{two}</p>") == two


def test_main_text_of_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<script>x") == ""
    assert main_text("just text") == "just text" and main_text("a < b & c") == "a < b & c"
    assert main_text('<p title="a > b">x</p><p title="open>y</p>') == "x\n\ny"
    assert main_text("<p>" * 3000 + "deep" + "</p>" * 3000) == "deep"
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages_of(extract_text(pages))
    assert len(got) == 4 and got[0]["text"] == got[1]["text"] == main_text(PAGE) and got[2]["text"] == ""
    assert extract_text(pages.limit(0)).count() == 0


def test_language_id_learns_and_covers_odd_rows(spark):
    docs = documents(spark, 160)
    net = lang_id.fit(docs)
    out = lang_id.classify(docs.withColumn("lang_pred", docs.hits), net)
    got = pages_of(out)
    assert len(got) == docs.count() and net.langs == ["en", "fr"]
    tested = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 160 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.9
    for r in got:
        none = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und" and r["lang_score"] == 0) == none and 0 <= r["lang_score"] <= 1
    kept = lang_id.keep_identified(docs)
    assert kept.columns == docs.columns
    empty = docs.limit(0)
    assert lang_id.classify(docs, lang_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_windows_cover_every_byte():
    for n in (1, 191, 192, 193, 384, 1000):
        raw = bytes(i % 251 + 1 for i in range(n))
        w = lang_id.to_windows(raw, 192)
        assert w.shape[1] == 192 and set(raw) <= set(w.ravel().tolist())


def test_convolution_matches_the_plain_sum():
    net = lang_id.train([b"abc abc", b"xyz xyz"] * 10, ["a", "x"] * 10, window=12, epochs=2)
    x = np.frombuffer(b"abcabcxyzabc", np.uint8)[None]
    z = np.array([[sum(net.emb[x[0, p + j]] @ net.filters[j, :, k] for j in range(5)) for k in range(net.filters.shape[2])] for p in range(8)])
    assert np.allclose(net.features(x)[0], np.maximum(z.max(axis=0) + net.bias, 0), atol=1e-4)


def test_factorisation_machine_equals_the_pair_sum():
    rng = np.random.default_rng(0)
    fm = quality_fm.train([], np.zeros(0))
    fm.w[:], fm.v[:] = rng.normal(size=fm.w.shape), rng.normal(size=fm.v.shape)
    at, x = np.array([3, 50, 700, 4099]), np.array([0.5, 1, 0.25, 0.5], np.float32)
    z = fm.w[at] @ x + sum(fm.v[at[i]] @ fm.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(fm.scores([(at, x), (at, x)])[1] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_quality_learns_and_covers_odd_rows(spark):
    good = [(i, f"word{i} and some other words number {i % 7} in a line. It goes on.") for i in range(200)]
    bad = [(i, f"BUY!!! {i}$$$ ### CLICK!!! *** {i % 9} &&&") for i in range(200, 400)]
    docs = spark.createDataFrame([(*x, "q") for x in good + bad + [(500, None), (501, ""), (None, "no id"), (3, "repeated id")]], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(7, 1, 1), (None, 1, 0), (9, None, 0), (900, 0, 0)], "doc_id long, quality int, toxic int")
    scored = pages_of(quality_fm.score(docs, quality_fm.fit(docs, labels)))
    assert len(scored) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in scored)
    held = [r for r in scored if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["quality_score"] >= 0.3) == (r["doc_id"] < 200) for r in held]) > 0.95
    untaught = quality_fm.fit(docs, labels.limit(0))
    assert quality_fm.score(docs, untaught).where("abs(quality_score - 0.5) > 0.2").count() == 0


CODECS = {p: piece_codec.PieceCodec.load(dropout=p) for p in (0.0, 0.3)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers())
def test_pieces_decode_losslessly(text, key):
    for codec in CODECS.values():
        assert codec.decode(codec.encode(text, key).tolist()) == text


def test_pieces_without_dropout_are_the_model_s_own():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=piece_codec.MODEL)
    for text in ["Hello world", "  two  spaces\n\tand tabs ", "déjà vu 日本語 🙂", "x" * 300, "supercalifragilistic " * 30]:
        assert CODECS[0.0].encode(text).tolist() == sp.encode(text)


def test_dropout_varies_and_repeats():
    codec, text = CODECS[0.3], "international understanding of the segmentation " * 8
    one, two = codec.encode(text, 1), codec.encode(text, 2)
    assert one.tolist() == codec.encode(text, 1).tolist() != two.tolist()
    assert len(one) > len(CODECS[0.0].encode(text))
    words = sorted(set(text.split())) + ["a", "日本語日本語", "e\n\nf", "y" * 24]
    for v in range(3):
        assert [list(memoryview(b).cast("i")) for b in codec.many_ids(words, v)] == [codec.segment_ids(w, v) for w in words]


def test_every_occurrence_draws_its_own_segmentation():
    codec = piece_codec.PieceCodec.load(dropout=0.1)
    word, n = " internationalisation", 5_000
    whole = codec.encode_all([(k, word[1:]) for k in range(n)])
    seen = {x.tobytes() for x in whole}
    assert len(seen) > 20
    keys = np.concatenate([codec._keys(k, 1) for k in range(n)])
    assert [x.tobytes() for x in whole] == codec.many_ids([word] * n, keys)  # what is cached changes nothing
    assert [x.tobytes() for x in whole[:300]] == [np.array(codec.segment_ids(word, int(k)), np.int32).tobytes() for k in keys[:300]]
    merges = codec.segment_ids(word, None, taken := []) and len(taken)
    touched = codec.first_skip(np.full(n, codec.known[word]), keys) >= 0
    assert abs(1 - touched.mean() - 0.9**merges) < 0.03
    text = codec.encode(word[1:] + word * 400, 7)
    assert codec.decode(text.tolist()) == word[1:] + word * 400 and len({codec.segment_ids(word, int(k)).__repr__() for k in codec._keys(7, 401)}) > 20


def plain_agenda(codec, s, key):
    """Take the best candidate of all neighbours that is not skipped, until there is none."""
    parts = [(i, i + 1) for i in range(len(s))]
    while True:
        best = None
        for k in range(len(parts) - 1):
            i, j = parts[k][0], parts[k + 1][1]
            r = codec.rank.get(s[i:j])
            x = (key + r * piece_codec.BY_RANK + i * piece_codec.BY_PLACE) & piece_codec.M64 if r is not None else 0
            if r is not None and piece_codec.mixed_one(x) >> 32 >= codec.limit and (best is None or (r, i) < best[:2]):
                best = (r, i, k)
        if best is None:
            break
        parts[best[2] : best[2] + 2] = [(parts[best[2]][0], parts[best[2] + 1][1])]
    return [x for i, j in parts for x in ([codec.ids[s[i:j]]] if s[i:j] in codec.ids else [codec.byte_ids[b] for b in s[i:j].encode()])]


def test_texts_match_a_plain_agenda():
    """Over many documents, so that cached outcomes of one, two and more skips are used."""
    for codec in (piece_codec.PieceCodec.load(dropout=0.3), piece_codec.PieceCodec.load(dropout=0.1)):
        text = "international understanding of  a segmentation\n日本語日本語 naïveté🙂 " + "z" * 40
        docs = [(k, text) for k in range(300)]
        for _ in range(2):
            got = codec.encode_all(docs)
        for (k, t), ids in zip(docs[::7], got[::7], strict=True):
            segments = piece_codec.SEGMENT.findall(" " + t)
            assert ids.tolist() == [x for s, key in zip(segments, codec._keys(k, len(segments)), strict=True) for x in plain_agenda(codec, s, int(key))]
        assert any(len(x) > 1 for x in codec.skips)


def test_pieces_of_a_table(spark):
    docs = documents(spark)
    codec = CODECS[0.3]
    encoded = piece_codec.encode_pieces(docs, codec)
    got = pages_of(encoded)
    assert len(got) == docs.count() and all(r["lossless"] for r in got if r["pieces"] is not None)
    assert [r["n_pieces"] for r in got if r["doc_id"] == 104] == [None] and [r["pieces"] for r in got if r["doc_id"] == 105] == [[]]
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in pages_of(piece_codec.decode_pieces(encoded, codec)))
    assert back == sorted((str(r["doc_id"]), str(r["text"])) for r in pages_of(docs))
    assert piece_codec.encode_pieces(docs.limit(0), codec).count() == 0
