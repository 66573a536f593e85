"""Line blocks against a plain loop, elements that hold the text under any name, and hostile pages."""

import random
import time

import numpy as np

from veriskill.llm.html_extract import REGION, SURGE, WINDOW, main_text, regions

ONE, TWO = ("One long sentence of the text goes on and on. " * 4).strip(), ("Another long sentence follows it here and there. " * 4).strip()


def brute_regions(length):
    n = len(length)
    sums = [sum(length[i : i + WINDOW]) for i in range(n)]
    if not any(sums):
        return []
    level = min(SURGE, max(1, max(sums) // 2))
    found, i = [], 0
    while i < n:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        lines = [k for k in range(i, min(n, j - 1 + WINDOW)) if length[k]]
        if max(sums[i:j]) >= level:
            found.append((lines[0], lines[-1] + 1, sum(length[k] for k in lines)))
        i = j
    most = max(x[2] for x in found)
    return [(a, b) for a, b, w in found if w >= REGION * most]


def test_regions_match_a_plain_loop():
    rng = random.Random(8)
    for _ in range(400):
        length = [rng.choice([0, 0, 0, 3, 20, 90, 300]) for _ in range(rng.randint(1, 40))]
        assert regions(np.array(length)) == brute_regions(length), length


def test_pages_without_names_match_a_plain_loop():
    rng = random.Random(9)
    for _ in range(60):
        lines = [(("word " * rng.choice([0, 1, 4, 40])).strip(), rng.random() < 0.3) for _ in range(rng.randint(1, 30))]
        html = "<body>" + "".join(f"<div><a href=x>{t}</a></div>" if link else f"<div>{t}</div>" for t, link in lines)
        kept = [(t, link) for t, link in lines if t]
        found = brute_regions([0 if link else len(t) for t, link in kept])
        assert main_text(html) == "\n\n".join(t for a, b in found for t, _ in kept[a:b])


def test_no_name_and_no_open_element_loses_the_text():
    for page in (
        f"<div class='content has-sidebar'><p>{ONE}</p></div>", f"<article class='post no-comments'><p>{ONE}</p></article>", f"<div>Site</div><div class='research search-hits'><p>{ONE}</p></div>",
        f"<div><aside>Aside</div><p>{ONE}</p>", f"<div><nav>Menu<ul><li>One</div><p>{ONE}</p>", f"<form><div class=menu>menu</div><p>{ONE}</p></form>", f"<fieldset><p>{ONE}</p></fieldset>", f"<ul><li class=ad>Buy<li><p>{ONE}</p></ul>",
    ):
        text = main_text(f"<body>{page}<div>Imprint</div></body>")
        assert ONE in text and not any(x in text.lower() for x in ("aside", "menu", "buy")), page
    assert main_text(f"<article><p>{ONE}</p></article><article><p>Short.</p></article>") == f"{ONE}\n\nShort."


def test_what_readers_write_and_menus_stay_out_however_long():
    page = f"<body><nav>{TWO * 9}</nav><article><h1><a href=x>Title</a></h1><p>{ONE}</p><section class='user-comments'><p>{TWO * 30}</p></section></article><div class='related-posts'>{TWO * 9}</div><footer>{TWO}</footer>"
    assert main_text(page) == f"Title\n\n{ONE}"
    assert main_text(f"<p>{ONE} <span class='ad'>Buy</span> and more</p>") == f"{ONE} and more"
    assert main_text(f"<div hidden><p>{TWO}</p></div><footer>{TWO}</footer>") == ""


def test_a_teaser_is_not_the_article():
    body = "".join(f"<p>{ONE if k % 2 else TWO}</p>" for k in range(10))
    page = f"<body><div class='text'>{body}</div><div class='side'><article class='card'><p>{'Teaser of another story. ' * 4}</p></article></div><div>Imprint</div></body>"
    text = main_text(page)
    assert text.count(ONE) == 5 and text.count(TWO) == 5


def test_nothing_within_the_article_is_cut_for_its_size():
    links = "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(4))
    page = f"<body><nav>Menu</nav><article><h1>Title</h1>{f'<p>{ONE}</p>' * 9}<ul>{links}</ul><p>A last and shorter paragraph ends the text here, with words enough to count.</p><ul>{links}</ul></article><footer>Foot</footer>"
    text = main_text(page)
    assert text.split("\n\n")[-5:] == ["Link 0", "Link 1", "Link 2", "Link 3", "A last and shorter paragraph ends the text here, with words enough to count."] and text.startswith("Title")


def test_names_of_several_words_within_the_article():
    for name in ("related-work", "informed-consent", "satellite-navigation", "notice-of-intent", "comment-on-the-budget", "ad-hoc"):
        assert main_text(f"<body><article><p>{ONE}</p><div id='{name}'><p>{TWO}</p></div></article></body>") == f"{ONE}\n\n{TWO}", name
    assert main_text(f"<article><p>{ONE} <span class='ad-hoc'>at once</span> it goes</p></article>") == f"{ONE} at once it goes"
    for name in ("related-posts", "newsletter-signup", "ad-box", "comment-list", "user-comments", "share-buttons", "cookie-notice"):
        assert main_text(f"<body><article><p>{ONE}</p><div id='{name}'><p>{TWO}</p></div></article></body>") == ONE, name
    assert main_text(f"<div class='comment-on-the-budget'><p>{ONE}</p></div>") == ONE


def test_hostile_pages_take_linear_time():
    for unit in ("<a ", '<a ">" ', "<div class=ad>x", "<!", "<b><p>", "<u><div>", "<form>x", "&#0", "<![CDATA[", "</b></p>", "<a '"):
        for page in (unit * (1_000_000 // len(unit)), unit * (200_000 // len(unit)) + ">"):
            began = time.process_time()
            main_text(page)
            assert time.process_time() - began < 12, unit
    assert main_text("&#" + "1" * 5000 + ";") == "�"
