"""Round trips and library agreement: BPE, token files, prefix counts, media chunks, pages."""

import array
import hashlib
import json
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import bpe_codec, html_text, media_chunks, prefix_counts, token_planes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "é", " ", "\n", "\t", "'s", "'re", "'", "!", "1", "²", "Ⅷ", "\x1c", "\x85", "　", "日", "😀", "𝒜", "<|endoftext|>", "the", "ß", "İ", "Σ", "\xa0", "é"]
odd_text = st.lists(st.sampled_from(ODD) | st.text(max_size=3), max_size=25).map("".join)
CASES = [(0, None), (1, ""), (2, "Plain text, the end."), (3, "x" * 5000 + " " + "ab" * 2000), (4, "a\n\n b <|endoftext|>"), (4, "a\n\n b <|endoftext|>"), (5, "日本語 text")]


def docs(spark, rows=CASES):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "1 as ids", "'x' as file", "2 as n", "3 as object")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@settings(max_examples=100, deadline=None)
@given(odd_text)
def test_bpe_is_the_library(library, text):
    for kind in (bpe_codec.ByteBpe, bpe_codec.LibraryBpe):
        bpe = kind.load(BYTES)
        packed = bpe.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert [*memoryview(packed).cast("I")] == want
        assert bpe.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    bpe = bpe_codec.ByteBpe.load(BYTES)
    random.seed(3)
    for _ in range(30):
        w = "".join(random.choice("abcdeté") for _ in range(200)).encode()
        ids = [bpe.of_byte[b] for b in w]
        assert bpe._merge_long(ids) == bpe.merge(w)


def test_bpe_query(spark, library):
    got = bpe_codec.digests(docs(spark), BYTES).collect()
    assert len(got) == len(CASES)
    for r in got:
        text = next(t for i, t in CASES if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_codec.digests(docs(spark).where("false"), BYTES).count() == 0


def test_token_files(spark, library):
    rows = [*CASES, (None, "none")]
    got = sorted(token_planes.read_files(token_planes.write_files(docs(spark, rows), BYTES)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 4, 4, 5]
    at = 0
    for r, text in zip(got, ["none", *[t for _, t in CASES]]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        at += len(ids)
    assert token_planes.read_files(token_planes.write_files(docs(spark).where("false"), BYTES)).count() == 0
    # Texts of one id, in any order of arrival.
    two = [(5, "a b"), (5, "a much longer text"), (5, None), (4, "x")]
    both = [sorted(map(tuple, token_planes.read_files(token_planes.write_files(docs(spark, x), BYTES)).collect())) for x in (two, two[::-1])]
    assert both[0] == both[1] and len(both[0]) == 4


def test_planes():
    random.seed(1)
    ids = [array.array("I", [random.randrange(1 << random.choice((3, 9, 17, 31))) for _ in range(n)]).tobytes() for n in (0, 1, 70_000, 5)]
    file = token_planes.pack([None, -5, 7, 7], ids)
    got = [(k, x.tobytes()) for k, x in token_planes.unpack(file)]
    assert got == [*zip([None, -5, 7, 7], ids)]
    assert token_planes.block_ids(file, 1).tobytes() == b"".join(ids)[4 * token_planes.BLOCK :]
    with pytest.raises(ValueError):
        [*token_planes.unpack(b"junk" + file[4:])]


@settings(max_examples=40, deadline=None)
@given(odd_text)
def test_every_prefix(text):
    counter = prefix_counts.PrefixCounter.load(WORDS)
    lib = counter.library
    packed = prefix_counts.pack(counter.deltas(text)) if text else prefix_counts.pack(prefix_counts.np.zeros(0, "i1"))
    counts = prefix_counts.counts(packed)
    assert counts[-1] == len(lib.encode(text, add_special_tokens=False).ids)
    norm = lib.normalizer.normalize_str(text)
    if "<|" not in text or norm == text:
        assert [*counts] == [len(lib.encode(norm[:k], add_special_tokens=False).ids) for k in range(len(norm) + 1)]
    best = max(k for k, c in enumerate(counts) if c <= 3)
    assert prefix_counts.fit(packed, 3) == best and prefix_counts.count_at(packed, best) == counts[best]


def test_prefix_query(spark):
    lib = Tokenizer.from_file(WORDS)
    for r in prefix_counts.prefix_counts(docs(spark), WORDS, budget=100).collect():
        text = next(t for i, t in CASES if i == r.doc_id) or ""
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())
        assert r.fit_chars == prefix_counts.fit(r.prefix, 100)


def test_chunks():
    random.seed(2)
    data = bytes(random.randrange(256) for _ in range(60_000))
    a, b, c = media_chunks.chunks([data, data[:7_000] + b"new" + data[7_000:], b"x" * 576])
    assert b"".join(a) == data and all(media_chunks.LEAST <= len(x) <= media_chunks.GREATEST for x in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 2  # an insertion changes the chunks around it only
    assert media_chunks.chunks([data])[0] == a  # whatever stands beside it
    assert c == [b"x" * 576]


def test_media_query(spark):
    random.seed(4)
    big = "".join(random.choice("abcdefgh ") for _ in range(90_000))
    rows = [*CASES, (6, big), (7, big[:50_000]), (8, big), (None, "none"), (9, "~" + big)]
    got = media_chunks.media(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = "none" if r.doc_id is None else next(t for i, t in rows if i == r.doc_id) or ""
        raw = text.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    _, stored = media_chunks.store(docs(spark, [r for k, r in enumerate(rows) if r not in rows[:k]]))
    kept = [d for r in stored.collect() for d, f in zip(r.digests, r.frames) if f is not None]
    assert len(kept) == len(set(kept))  # each chunk is stored once
    assert media_chunks.media(docs(spark).where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>The site of all the news that is fit for you and for me and the others in it</h1></header>
<nav><ul><li><a href=/a>Home</a></ul></nav><!-- ad --><div class="ad">%s</div>
<article><h1>A title</h1><p><b>First &amp; line.<br><p>%s</p><p>Short.</p><ul><li><a href=x>Related</a></li></ul>
<section id="comments"><p>%s</p></section></article><aside><p>%s</p></aside><form>%s</form><footer>&copy; x</footer>"""
LONG = "This is one of the things that was said to be in the middle of it all, and it is not the last of them that we have."


def test_page():
    got = html_text.main_text(PAGE % ((LONG,) * 5))
    assert got == f"A title\nFirst & line.\n{LONG}\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    # Without an article, short blocks go with their nearest decided neighbours.
    got = html_text.main_text(f"<div>Menu</div><div class=menu>x</div><p>{LONG}</p><p>Near.</p><p>{LONG}</p><div class='footer'>f</div>")
    # What stands before the first decided block goes with it.
    assert got == f"Menu\n{LONG}\nNear.\n{LONG}"
    assert html_text.main_text("<article><p>&lt;b&gt; a\n  b &#233;</article>") == "<b> a b é"
    assert html_text.main_text("<article><p>a<!-- never closed <p>b") == "a"
    assert html_text.main_text("<article><p>one<br>two</p></article>") == "one two"


@pytest.mark.parametrize(
    "page",
    [
        '<article title="Hidden gems"><p>{}</p></article>',
        '<article><div data-title="A hidden story">{}</div></article>',
        '<article><p data-role="search">{}</p></article>',
        '<article><div title="the id=ad thing">{}</div></article>',
        '<article><div class="social-history">{}</div></article>',
        '<article><section id="related-work"><p>{}</p></section></article>',
        "<article data-x='hidden' data-y=hidden class=story>{}</article>",
    ],
)
def test_attributes_are_read_as_such(page):
    assert html_text.main_text(page.format(LONG)) == LONG


@pytest.mark.parametrize("part", ["class=sidebar", "id='post-comments'", 'class="ad-box x"', "hidden", 'aria-hidden="true"', "style='display: none'", "class=related-posts", "role=search"])
def test_parts_that_are_no_article(part):
    assert html_text.main_text(f"<article><p>{LONG}</p><div {part}><p>{LONG}</p></div></article>") == LONG


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Read <button>Share</button> this.</p>", "Read this."),
        ("<article><p>Read <span class=ad>buy <b>now</b></span>this <label>x</label>, too.</p><p>Next.", "Read this , too.\nNext."),
        ("<article>Read <span class=ad>buy <div>much</div></span> this.", "Read\nthis."),
        ("<article><p>Read <button>Share</p><p>This.</p>", "Read\nThis."),
        ("<article><p>Pick</p><select><option>One<option>Two</select><p>That.</p>", "Pick\nThat."),
    ],
)
def test_left_out_inside_a_block(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div><span>" * 20_000 + LONG + "</span></div>" * 20_000
    assert html_text.main_text(deep) == LONG
    assert html_text.main_text(f"<p>{LONG}</p>" * 20_000) == "\n".join([LONG] * 20_000)


def test_page_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ((LONG,) * 5)), (2, None, None), (None, "v", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    got = html_text.extract(df.selectExpr("*", "1 as text", "'z' as n_chars")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, len(f"A title\nFirst & line.\n{LONG}\nShort.")), (2, 0), (2, 0)]


def test_vocabulary_path_is_a_parameter(tmp_path):
    spec = json.load(open(BYTES))
    spec["added_tokens"] = []
    p = tmp_path / "v.json"
    p.write_text(json.dumps(spec))
    text = "a <|endoftext|> b"
    want = Tokenizer.from_file(str(p)).encode(text, add_special_tokens=False).ids
    assert [*memoryview(bpe_codec.ByteBpe(str(p)).encode(text)).cast("I")] == want
