"""HTML extraction: named cases, and pages made from a known text in containers of many kinds."""

import random

from tracewright.llm import html_text

SAID = "A paragraph of prose with a good many words in it, so that its text is long beside its tags. " * 2
main = html_text.main_text


def test_class_words_do_not_hide_the_article():
    for name in ("share-price-analysis", "social-science", "login-security-guide", "comment-on-policy", "search-engine-history", "skipping-stones"):
        assert main(f'<nav><a href="/">Home</a></nav><div class="{name}"><p>{SAID}</p></div>') == SAID.strip()
        assert main(f'<article><section id="{name}"><p>{SAID}</p></section></article>') == SAID.strip()


def test_named_parts_stand_apart():
    for name in ("comments", "comment-list", "site-footer", "sidebar left", "ad-slot-2", "mainNav", "related_posts", "cookie-consent", "newsletterSignup"):
        assert main(f'<div><p>{SAID}</p></div><div class="{name}"><p>{SAID}</p></div>') == SAID.strip()
        assert main(f'<article><p>Short news.</p></article><div class="{name}"><p>{SAID * 9}</p></div>') == "Short news."


def test_short_first_and_last_lines_and_headings_stay():
    page = f"<body><nav>menu</nav><h1>Title</h1><div><p>Short lead.</p><p>{SAID}</p><h2>Part</h2><p>{SAID}</p><p>End.</p></div><ul><li><a href=a>one</a><li><a href=b>two</a></ul></body>"
    assert main(page) == f"Title Short lead. {SAID}Part {SAID}End."


def test_inline_controls_keep_their_words():
    assert main(f"<article><p>Press <button>Start</button> for <math><mi>x</mi></math>. {SAID}</p><button>Share</button></article>") == f"Press Start for x. {SAID.strip()}"


def test_clusters_decide_not_the_tag():
    """A teaser is marked as an article; the text stands in plain containers, or in what is marked as an aside."""
    page = f'<article><a href="/x">Read this</a></article><div><p>{SAID}</p><p>{SAID}</p><p>Short end.</p></div>'
    assert main(page) == f"{SAID}{SAID}Short end."
    two = f'<main><article><h1>T</h1><p>{SAID}</p><p>{SAID}</p></article><article class="card"><a href=x>Another</a></article></main>'
    assert main(two) == f"T {SAID}{SAID.strip()}"
    assert main(f"<body><aside><p>{SAID}</p></aside><nav><a href=a>{SAID}</a></nav></body>") == SAID.strip()
    assert main(f"<nav>{SAID}</nav><footer>{SAID}</footer><form>{SAID}</form>") == ""


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def made_page(rng):
    """A page without article or main, and its text: the blocks of one container, or of one and the page itself, other parts around."""
    blocks, html = [], []
    for k in range(rng.randint(3, 9)):
        tag = "h2" if k and rng.random() < 0.15 else rng.choice(["p", "p", "p", "blockquote", "li"])
        text = prose(rng, rng.randint(2, 5) if tag == "h2" or (k and rng.random() < 0.2) else rng.randint(30, 90))
        blocks.append(text)
        cut = rng.randrange(len(text))
        inner = rng.choice([text, f"<b>{text[:cut]}</b>{text[cut:]}", f"{text[:cut]}<!-- no --><i>{text[cut:]}</i>"])
        html.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
    half = rng.randint(1, len(html))
    sides = sorted(sum(len(b) for b in part if len(b) > 150) for part in (blocks[:half], blocks[half:]))  # a part that is small beside the other could be anything
    body = rng.choice([
        "".join(html), f'<div class="entry">{"".join(html)}</div>', f'<div id="wrap"><div class="text-{rng.randint(1, 9)}">{"".join(html)}</div></div>', f"<section>{''.join(html[:half])}</section>{''.join(html[half:])}" if 2 * sides[0] > sides[1] else "".join(html),
        f"<table><tr><td>{''.join(html)}</td></tr></table>",
    ])
    links = lambda n: "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(n))
    before = rng.choice(["", f"<nav><ul>{links(6)}</ul></nav>", f'<header><h1>{prose(rng, 2)}</h1></header><ul class="menu">{links(5)}</ul>', f'<div class="top-nav">{links(4)}</div><script>var a = "<p>";</script>'])
    after = rng.choice(["", f"<footer>{prose(rng, 8)}</footer>", f'<div class="related">{links(5)}</div><aside><p>{prose(rng, 30)}</p></aside>', f'<section class="comments"><p>{prose(rng, 40)}</p></section><form><p>{prose(rng, 5)}</p></form>'])
    return f"<html><head><title>{prose(rng, 4)}</title><style>p {{}}</style></head><body>{before}{body}{after}</body></html>", " ".join(blocks)


def test_made_pages_give_their_text(spark):
    rng = random.Random(6)
    pages = [made_page(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, h, "x") for i, (h, _) in enumerate(pages)], "page_id long, html string, N_CHARS string").repartition(4)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    wrong = [i for i, (_, text) in enumerate(pages) if got[i].text != text]
    assert not wrong, (len(wrong), pages[wrong[0]], got[wrong[0]].text)
    assert all(r.n_chars == len(r.text) for r in got.values())
