"""Kernels against the libraries and against brute force, without Spark."""

import html
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest

from pairlake.llm import decontaminate, extract, packing, piececount, quality, tokenfiles, toxicity
from pairlake.llm.common import WordHash
from pairlake.llm.dartminhash import band_keys, elements, signature

PARTS = ["the", "he", "re", "in", "ing", " ", "  ", "e", "t", "\n", "th", "an", "▁", "é", "ü", "0", "12", ".", "her", "🙂", "日本"]
ODD = ["", " ", "   x", " " * 100 + "hello", " " * 57, "a" + " " * 40 + "b", "<s> </s> <0x0A>", "a" * 3000, "the" * 500, "\x00a\x01"]


def texts(n=300):
    chooser = random.Random(5)
    return ODD + ["".join(chooser.choice(PARTS) for _ in range(chooser.randint(1, 60))) for _ in range(n)]


def test_piece_counts_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = piececount.Counter(piececount.Pieces(path))
    given = texts()
    assert counter.totals(given) == [len(x) for x in library.encode(given, num_threads=1)]


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    given = [*texts(), "a <|endoftext|> b<|endoftext|>", "x<|endoftext|>  \n y", "a\x1cb .\x1c. c\x85d", "a\t\n b  \n\n c", "don't 's"]
    ids, offsets = tokenfiles.Chunks(path).encode(given)
    for text, low, high in zip(given, offsets, offsets[1:]):
        assert ids[low:high].tolist() == [*library.encode(text, add_special_tokens=False).ids, tokenfiles.END]


def test_chunked_encoding_of_random_white_space():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    chooser = random.Random(7)
    parts = [" ", " ", "\n", "\t", "\r", "\u00a0", "\u3000", "\x1c", "\x85", "a", "b1", "it's", "é", "<|endoftext|>", "."]
    for size in (3, 12, 60):
        given = ["".join(chooser.choices(parts, k=chooser.randrange(size))) for _ in range(2000)]
        ids, offsets = tokenfiles.Chunks(path).encode(given)
        for text, low, high in zip(given, offsets, offsets[1:]):
            assert ids[low:high].tolist() == [*library.encode(text, add_special_tokens=False).ids, tokenfiles.END]


def test_repeated_words_by_brute_force():
    chooser = random.Random(1)
    for _ in range(200):
        words = [chooser.choice([b"a", b"b", b"c"]) for _ in range(chooser.randint(0, 40))]
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
        assert quality.repeated_words(words) == len(covered)


def test_signatures_agree_as_often_as_sets_are_similar():
    hashes = WordHash()
    base = [b"w%d" % i for i in range(400)]
    other = base[:360] + [b"x%d" % i for i in range(40)]
    a, b = (elements(w, hashes.of(w)) for w in (base, other))
    shared = len(np.intersect1d(a, b))
    agree = np.mean(signature(a, 2048) == signature(b, 2048))
    assert abs(agree - shared / (len(a) + len(b) - shared)) < 0.05
    assert len(set(band_keys(signature(a)).tolist())) == 24


def test_multiplicity_is_a_weight():
    hashes = WordHash()
    once, twice = [b"a b c d e".split() * n for n in (1, 2)]
    assert len(elements(once, hashes.of(once))) == 1
    assert len(elements(twice, hashes.of(twice))) == 6
    assert len(elements([], hashes.of([]))) == 0


@pytest.mark.parametrize("seed", range(5))
def test_packing_places_every_piece_once(seed):
    chooser = random.Random(seed)
    histogram = {chooser.randint(1, 512): chooser.randint(1, 50) for _ in range(60)} | {512: 9, 1: 700}
    ranges = packing.plan(histogram, (64, 128, 512))
    length = np.concatenate([np.full(c, n) for n, c in histogram.items()])
    rank = np.concatenate([np.arange(c) for c in histogram.values()])
    found = packing.locate(ranges, length, rank)
    bins = {}
    for n, b, at, size, used in zip(length, *(found[k] for k in ("bin_id", "offset", "bin_size", "bin_used"))):
        bins.setdefault(b, []).append((at, at + n, size, used))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        size, used = parts[0][2:]
        assert parts[-1][1] == used <= size
        assert size == min(s for s in (64, 128, 512) if s >= used)
    waste = sum(p[0][2] - p[0][3] for p in bins.values()) / sum(p[0][2] for p in bins.values())
    assert waste < 0.2


def test_packing_refuses_pieces_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.plan({700: 1}, (512,))
    assert len(packing.plan({}, (512,))["bin"]) == 0


ITEMS = [
    (1, "What colour is the tall house by the river? The tall house by the river is green."),
    (2, "Name the smallest planet of the solar system. It is Mercury, which has no moon."),
    (3, ""),
    (4, None),
]


def test_search_finds_every_item_above_the_threshold():
    chooser = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(chooser.choices(vocabulary, k=12))) for i in range(150)])
    for _ in range(100):
        terms = np.array([index.terms[w.encode()] for w in chooser.sample(vocabulary, 25)])
        score = np.zeros(150)
        for t in terms:
            score[index.items[t]] += index.share[t]
        expected = {i for i in range(150) if score[i] >= decontaminate.THRESHOLD - 1e-9}
        assert set(index.search(terms)) == expected


def test_leaks():
    index = decontaminate.Index(ITEMS)
    assert index.ids.tolist() == [1, 2]
    filler = "some other words stand here without any meaning " * 30
    for n, (_, text) in enumerate(ITEMS[:2]):
        assert set(index.leaks(filler + text.upper().replace(" ", "\n") + " " + filler)) == {n}
    assert index.leaks(filler) == {} and index.leaks("") == {}
    assert index.leaks("the tall house by the river " + filler) == {}
    assert decontaminate.Index([]).leaks("any text") == {}


def test_edited_items_and_questions_alone_are_leaks():
    """Retrieval by brute force: every item whose shingles a passage holds in a proof's share."""
    chooser = random.Random(7)
    common = [f"c{i}" for i in range(40)]

    def sentence(n, rare):
        return " ".join(f"r{chooser.randrange(10**6)}" if k < rare else chooser.choice(common) for k in range(n)) + ". "

    # Questions are of common words and answers of rare ones, so that BM25 weighs the answer.
    items = [(i, sentence(chooser.randint(5, 14), 0) + sentence(chooser.randint(8, 30), 8)) for i in range(60)]
    index = decontaminate.Index(items)
    filler = " ".join(f"f{i}" for i in range(300))
    for n, (_, text) in enumerate(items):
        question, answer = decontaminate.split_item(text)
        words = [w.decode() for w in question + answer]
        assert n in index.leaks(f"{filler} {' '.join(words[: len(question)])} {filler}")
        assert n in index.leaks(f"{filler} {' '.join(words[len(words) // 5 :])} {filler}")
        for k in range(len(words)):
            edited = words[:k] + ["other"] + words[k + 1 :]
            found = decontaminate.shingles([w.encode() for w in edited])
            own = decontaminate.shingles([w.encode() for w in words])
            if len(own & found) >= 0.5 * len(own):
                assert n in index.leaks(f"{filler} {' '.join(edited)} {filler}")
    short = decontaminate.Index([(1, "Who was it? " + sentence(20, 10))])
    assert short.leaks(f"{filler} who was it {filler}") == {}


PAGE = """<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body class="has-sidebar"><nav><ul><li>Menu</ul></nav>
<div class="cookieNotice">We use cookies</div><article><header>Site</header><h1>Title &amp; more</h1><p><b>One<br>two
<p>Three&nbsp;<i>fo</i>ur.</p><aside>Side</aside><form>Mail</form><p>Be.</p><section id="comments"><p>Reader said</p></section></article>
<footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Title & more\n\nOne two\n\nThree four.\n\nBe."
    for empty in (None, "", "<p></p>", "<script>x</script>", "<nav>menu</nav>"):
        assert extract.main_text(empty) == ""
    assert extract.main_text("only  text") == "only text"
    body = "".join(f"<p>{'long sentence of the story ' * 8}{i}</p>" for i in range(5))
    page = f"<body><div class=menu>a b c</div><div><div id=story>{body}</div><div><a>x</a> <a>y</a></div></div></body>"
    assert extract.main_text(page).count("\n\n") == 4 and extract.main_text(page).endswith(" 4")


STORY = "".join(f"<p>{'long sentence of the story ' * 8}{i}</p>" for i in range(5))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><nav>menu of links</nav>{STORY}<footer>foot</footer></form></body>",
        f"<body><header>Site</header><div class='elementor-widget text'>{STORY}</div><footer>foot</footer></body>",
        f"<body><form><div class='widget'>{STORY}</div><div class=sidebar>{'menu ' * 200}</div></form></body>",
        f"<body><div>{STORY}</div><form>foot <input></form><div class=widget>menu</div><div id=comments>menu {STORY * 9}</div></body>",
    ],
)
def test_wrappers_with_marks_are_opened(page):
    found = extract.main_text(page)
    assert found.split("\n\n") == [f"{'long sentence of the story ' * 8}{i}" for i in range(5)]


def test_forms_and_boxes_stay_closed():
    assert extract.main_text("<form>Search the site <input></form>") == ""
    assert extract.main_text(f"<div class=widget><nav>{STORY}</nav></div>") == ""
    assert extract.main_text(f"<div id=comments>{STORY}</div><p>short</p>") == "short"


def test_deep_pages_are_linear_work():
    started = time.process_time()
    for page in ("<div>" * 100_000 + STORY, "<b><ul>" * 100_000 + STORY + "</b>" * 100_000, "<form class=widget>" * 100_000 + STORY):
        assert extract.main_text(page).count("\n\n") == 4
    assert time.process_time() - started < 60


def test_main_text_of_all_pages_by_their_structure():
    """The given pages' articles hold headings and paragraphs only, so patterns can cut them."""
    pages = duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(pages) > 100
    for (page,) in pages:
        article = re.search(r"<article>(.*?)</article>", re.sub(r"<script>.*?</script>", "", page), re.S).group(1)
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", article))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        assert extract.main_text(page) == "\n\n".join(b for b in blocks if b)


def test_folding_and_exceptions():
    assert toxicity.folded("ІDІОТ 1d10t m0r0n $tupid 2024") == ["idiot", "idiot", "moron", "stupid", "2024"]
    lexicon = toxicity.Lexicon({" trash": 2.0, " idiot": 3.0})
    assert sum(w for *_, w in lexicon.matches(toxicity.folded("put it in the trash can, 1diot"))) == 3.0
    assert lexicon.matches(toxicity.folded("atrash")) == []
    assert toxicity.Lexicon({}, ()).figures("") == (0.0, 0.0)
