"""Scalar functions against rules, round trips and titles that are put together from known parts."""

import itertools
import random
import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import bibtex, latex, names, text, titles

NAMES = ["Symposium on Tidal Mechanics", "Meeting of the Ring Observers' Union", "Conference on Comets and Dust"]
FRONTS = ["", "Proceedings of the ", "Proc. ", "7th ", "2012 ", "Proceedings of the 2012 ", "Forty-First ", "Sixth "]
TAILS = ["", ", Oslo, Norway", ", Oslo, Norway, May 12-14, 2012", ", Proceedings", ", June 3, 2012, Part IV", ", Lima, Peru, Oct. 2-4, 2012, Volume 12"]


@pytest.mark.parametrize("name, front, tail", list(itertools.product(NAMES, FRONTS, TAILS)))
def test_booktitles_are_made_of_parts(name, front, tail):
    """Whatever stands before the name and after the short name goes; without a short name the name alone stays."""
    assert titles.clean_booktitle(f"{front}{name}{tail}", "clean", None, 2012) == name
    for short, acronym in (("GRAV 2012", "GRAV"), ("GRAV 2012", None), ("{GRAV} 2012", "GRAV"), ("GRAV", "GRAV")):
        whole = f"{front}{name}, {short}{tail}"
        assert titles.clean_booktitle(whole, "clean", acronym, 2012) == f"{name}, {short}"
        assert titles.clean_booktitle(whole, "acronym", acronym, 2012) == short
        assert titles.clean_booktitle(whole, "keep", acronym, 2012) == whole
        if any(c.isdigit() for c in short):
            for joint in (", ", ": "):
                assert titles.clean_booktitle(f"{short}{joint}{front}{name}{tail}", "clean", acronym, 2012) == f"{name}, {short}"
    assert titles.clean_booktitle(f"{front}{name}{tail}", "acronym", "GRAV", 2012) == "GRAV 2012"


def test_words_to_strip():
    assert titles.clean_booktitle("8th International Annual Workshop on Rings, RNG 2001", "clean", "RNG", 2001, ["International", "Annual"]) == "Workshop on Rings, RNG 2001"
    assert titles.clean_booktitle("Annual Non-International Workshop on Rings", "clean", None, 2001) == "Annual Non-International Workshop on Rings"
    assert titles.clean_booktitle("Workshop, Proceedings", "clean") == "Workshop, Proceedings" and titles.clean_booktitle(None) is None


def test_years_are_the_nearest_ones():
    for own in range(1930, 2090, 7):
        for two in range(100):
            near = min((y for y in range(own - 120, own + 120) if y % 100 == two), key=lambda y: (abs(y - own), y))
            assert titles.full_years(f"GRAV'{two:02} x", own) == f"GRAV {near} x"
            kept = f"GRAV {own} x" if own % 100 == two else f"GRAV-{two:02} x"
            assert titles.full_years(f"GRAV-{two:02} x", own) == kept
    for two in range(100):
        last = max(y for y in range(1900, 2032) if y % 100 == two)
        assert titles.full_years(f"GRAV ’{two:02}", None, today=2030) == f"GRAV {last}"
    for same in ("the '30s", "GRAV-1-12", "1'23'", "GRAV-2013"):
        assert titles.full_years(same, 2012) == same
    assert titles.full_years("GRAV-2012", 2012) == "GRAV 2012"


def test_titles_of_records():
    assert titles.record_title("Plain.", None) == "Plain" and titles.record_title("And so on..", None) == "And so on.." and titles.record_title(None, None) == ""
    assert titles.record_title("x", "H<sub>2</sub>O &amp; <i>ice</i> x<sup>n</sup>.") == f"H{latex.SUB}2{latex.END}O & ice x{latex.SUP}n{latex.END}"
    assert titles.first_title_word("On the 3 Moons") == "Moons" and titles.first_title_word("To be") == ""


LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and latex.to_latex(c) != c)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS + string.ascii_letters + " ", max_size=30))
def test_letters_come_back_from_latex(value):
    made = latex.to_latex(value)
    assert made.isascii() and latex.to_unicode(made) == unicodedata.normalize("NFC", " ".join(value.split()))
    assert latex.to_latex(value, False) == value


def test_latex():
    assert len(LETTERS) > 150
    for char, command in latex.RESERVED.items():
        assert latex.to_latex(f"a{char}b") == latex.to_latex(f"a{char}b", False) == f"a{command}b"
    assert latex.to_latex("θ Ω") == r"{\(\theta\)} {\(\Omega\)}" and latex.to_latex("½日") == "½日"
    assert latex.to_latex(f"x{latex.SUP}n+1{latex.END}") == r"x{\(^{n+1}\)}"
    words = {"eTau": True, "Io": False, "NASA": True, "X": False, "lower-Case": False, "iO-x": True, "A9B": True}
    for word, braced in words.items():
        for begin, end in (("", ""), ("(", "):"), ('"', '",')):
            want = f"{begin}{{{word}}}{end}" if braced else f"{begin}{word}{end}"
            assert latex.to_latex(f"of {begin}{word}{end} x", True, True) == f"of {want} x"
    assert latex.to_unicode(r"M\o{}ns \aa{} {\L}ena, Zo\"e~\v{C} \k a") == "Møns å Łena, Zoë Č ą"
    assert latex.to_display(r"\emph{big} $x$ \LaTeX moons") == "big x moons"


def test_names():
    assert names.abbreviate("Ada Beatrix Cole") == "A. B. Cole" and names.abbreviate("Ole von der Heide Jr.") == "O. von der Heide Jr."
    assert names.abbreviate("Anne-Lise Bakke") == "A.-L. Bakke" and names.abbreviate("Plato") == "Plato"
    assert names.split_names("{Rock and Ice} and Mia Lund and others") == ["{Rock and Ice}", "Mia Lund"]
    assert names.fold_name("Bjørg Łęcka 0004") == names.fold_name("Bjorg Lecka") == "bjorglecka"
    assert names.overlap([], ["x"]) == 0 and names.overlap_of_names([], ["x"]) == 1 and names.overlap(["cole", "lund"], ["Ada Cole"]) == 0.5
    assert names.last_name("Ada Cole III 0002") == "cole" and names.bib_last_names("Cole, Ada and others and M. Lund") == ["cole", "lund"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcDEéøńß", min_size=1, max_size=8), min_size=2, max_size=3))
def test_plain_names(words):
    *first, last = words
    plain = " ".join(words)
    assert names.plain_name(latex.to_latex(plain)) == unicodedata.normalize("NFC", plain)
    assert names.plain_name(latex.to_latex(f"{last}, {' '.join(first)}")) == unicodedata.normalize("NFC", plain)
    assert names.plain_name(f"{last}, Jr, {first[0]}") == f"{first[0]} {last} Jr"


def test_bibtex_reads_what_it_writes():
    rng = random.Random(4)
    value = lambda: "".join(rng.choice(["moon", " ", "{R}", '"', r"\"o", "#", ",", "=", "é", r"\{"]) for _ in range(rng.randrange(1, 6)))
    made = []
    for n in range(300):
        fields = [(name, value()) for name in rng.sample(["title", "note", "author", "year"], rng.randrange(1, 4))]
        made.append((rng.choice(["misc", "book"]), f"k{n}:x/y", fields))
    blocks = [bibtex.render(t, k, f) for t, k, f in made]
    items = bibtex.parse("\n\n".join(blocks))
    assert [(i.type, i.key, i.fields) for i in items] == made and [i.raw for i in items] == blocks
    assert all(bibtex.same_entry(i, bibtex.parse(bibtex.relayout(i))[0]) for i in items)


def test_bibtex_reader():
    source = """a remark
@Comment{ {nested} text }
@String{cc = "Communications"}
@Book ( moon-1, TITLE = "The {"}Far{"} Side" # cc , year=1999,, note = cc
)
@misc{bad key, note = {x}}
@misc{open, note = {never closed
@misc{ok, note = {fine}, note = 12}
"""
    items = bibtex.parse(source)
    assert [(i.kind, i.key) for i in items] == [("other", None), ("other", None), ("other", None), ("entry", "moon-1"), ("other", None), ("other", None), ("entry", "ok")]
    book = items[3]
    assert (book.type, book.fields) == ("book", [("title", '"The {"}Far{"} Side" # cc'), ("year", "1999"), ("note", "cc")])
    assert set(book.exprs) == {"title", "note"} and items[4].error and items[5].error and items[0].raw == "a remark"
    assert items[6].fields == [("note", "fine"), ("note", "12")] and bibtex.field_of(items[6], "note") == "fine" and bibtex.field_of(items[6], "x") is None
    assert bibtex.set_key("@misc{old, a=1}", "new") == "@misc{new, a=1}" and bibtex.sniff_key(" @misc( old,") == "old"
    assert bibtex.parse("") == bibtex.parse(None) == [] and bibtex.first_entry("none") is None


def test_normalised_titles():
    assert text.norm_title("Möbius's {\\LaTeX} Moon-Map") == "mo biuss moon map"
    assert text.strip_markup("a <i>b</i> &aring;\n c ") == "a b å c"


def test_word_diff_is_a_longest_common_subsequence():
    rng = random.Random(9)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("wxyz") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        a, b = (re.split(r"(\s+)", " ".join(words)) for words in (a, b))  # white space counts as words
        left, right = text.word_diff("".join(a), "".join(b))
        kept = [[p for p, new in side if not new] for side in (left, right)]
        assert [p for p, _ in left] == a and [p for p, _ in right] == b
        assert kept[0] == kept[1] and len(kept[0]) == longest(a, b)


def test_cut_entities_stay():
    raw = "<p>a &amp; b&quot;&amp;lt; &copy=1 &#38;&#x26; &nosuch; &notit; &AMP &amp"
    assert text.strip_markup(raw, closed=True) == 'a & b"&lt; &copy=1 && &nosuch; &notit; &AMP &amp'
    assert text.strip_markup("&copy 1 &amp") == "© 1 &" and text.strip_markup(None, closed=True) is None


def test_cut_pages(spark, tmp_path):
    import duckdb

    from lectern.plans import catalogue

    con = duckdb.connect()
    pages = [(1, "<p>a &amp; b &copy; c&amp"), (2, "x &quot y&lt"), (3, "&middot;&amp;quot; <b>&am"), (4, None)]
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", pages)
    con.execute(f"copy pages to '{tmp_path}/pages.parquet' (format parquet)")
    got = {tuple(r) for r in catalogue.entity_decode_strip(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalogue.ORACLES["entity_decode_strip"]).fetchall())
