import random
import time

import pytest

from crawlsmith.llm import html_text


def text(page):
    return html_text.extract(page)[1]


def test_odd_numbers_never_stop_a_page():
    for value in ("--5", "²", "9" * 5000, "٣", "", " ", "-", "+7", "5px", "1e9", "\x00", "0x10", "-3", "९", "1" * 9, "1" * 10):
        text(f'<ol start="{value}"><li>a<li>b</ol><table><tr><td colspan="{value}" rowspan="{value}">c<td>d<tr><td>e</table>')
    assert text("<ol start=' 7 '><li>a</ol>") == "7. a" and text("<ol start='5px'><li>a</ol>") == "5. a" and text("<ol start=-3><li>a<li>b</ol>") == "-3. a\n-2. b"
    assert text(f"<ol start='{'9' * 5000}'><li>a</ol>") == "1. a" and text("<ol start='²'><li>a</ol>") == "1. a"


def test_random_attributes_and_nesting():
    rng = random.Random(4)
    tags = "table tr td th tbody caption ol ul li p div span pre details summary dialog dl dt dd select option optgroup input br img rp ruby svg text h1 h2 a b".split()
    names = "colspan rowspan start hidden style open popover label value type class alt".split()
    values = ["", "0", "-1", "2", "3", "1000", "65534", "99999999999", "²", "display:none", "display:none;display:block", "visibility:hidden", "submit", "x y", "&lt;", "\u0000", "é", "%", "'", "None", "+-2", "1.5", "true"]
    for _ in range(5000):
        parts = []
        for _ in range(rng.randint(1, 12)):
            tag = rng.choice(tags)
            attributes = "".join(f' {rng.choice(names)}="{rng.choice(values)}"' for _ in range(rng.randint(0, 3)))
            parts.append(rng.choice([f"<{tag}{attributes}>", f"<{tag}{attributes}>t{rng.randint(0, 9)}", f"</{tag}>", "word ", "<!--c-->", "<", "<a '", '<b "']))
        html_text.extract("".join(parts))


@pytest.mark.parametrize(
    "page",
    [
        "<table>" + "<tr>" + "<td colspan=1000 rowspan=1000>x" * 300,
        "<table>" + "<tr><td rowspan=65534>x" * 40_000,
        "<table>" + "".join(f"<tr><td rowspan={2 + k % 997}>x<td>y" for k in range(25_000)),
        "<table>" + "<tr><td colspan=1000>x<td>y" * 35_000,
        "<table><tr><td>" + "w" * 200_000 + "<td>a" + "<tr><td>b<td>c" * 50_000,
        "<div>" * 4000 + "</p>" * 200_000,
        "<div>" * 4000 + "</x>" * 200_000 + "<br/>" * 20_000,
        "<a " * 330_000,
        '<a "' * 250_000,
        "<p>" * 300_000,
        "<li>" * 250_000,
        "<!--" * 250_000,
        "<td>" * 250_000,
        "<b>x</b> " * 100_000,
    ],
)
def test_a_long_page_takes_time_and_room_in_proportion(page):
    began = time.process_time()
    got = text(page)
    assert time.process_time() - began < 4 and len(got) < 8 * len(page) + 100_000


def test_spans():
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert text("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>") == "a |   | b\nc | d | e"
    assert text("<table><tr><td colspan=900>a<td>b<tr><td>c<td>d</table>").split("\n")[1] == "c | d"
    assert text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a | b\n  | c\n  | d"


def test_what_is_shown():
    assert text("<dialog>a</dialog><dialog open>b</dialog><div popover>c</div>d") == "bd" or text("<dialog>a</dialog><dialog open>b</dialog><div popover>c</div>d").split() == ["b", "d"]
    assert text("<ruby>字<rp>(</rp><rt>zi</rt><rp>)</rp></ruby>") == "字zi"
    assert text("<p>go <input type=submit value='Go'> <input type=hidden value=x><input type='BUTTON' value='Stop &amp; see'></p>") == "go Go Stop & see"
    assert text("<p style='display:none;display:block'>a</p><p style='display:block; display : none'>b</p>") == "a"
    assert text("<select><optgroup label=Fruit><option label=Pear>p<option>apple</select>").split() == ["Fruit", "Pear", "apple"]


def test_rows_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "<ol start='--5'><li>a</ol>", "x"), (1, "<td colspan='²'>b", "x"), (None, None, "x"), (3, "", None)], "page_id bigint, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_blocks) for r in html_text.extract_text(pages).collect())
    assert got == [("1", "1. a", 1), ("1", "b", 1), ("3", "", 0), ("None", None, 0)]
