import random

from tidemark.llm import extract

LONG = "This is a paragraph of the story, and it goes on for a while, as paragraphs of stories do, until it comes to an end."


def paragraphs(n, text=LONG):
    return [f"{text} No. {k}." for k in range(n)]


def html(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


def cost(scores, edges, kept):
    out = sum(-s for s, k in zip(scores, kept) if k and s < 0) + sum(s for s, k in zip(scores, kept) if not k and s > 0)
    return out + sum(w for a, b, w in edges if kept[a] != kept[b])


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-4, 4) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min(cost(scores, edges, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(scores, edges, extract.min_cut(scores, edges)) - best) < 1e-6


def test_neighbours_correct_single_labels(monkeypatch):
    one, two = paragraphs(2)
    page = f"<body><div>{html([one])}<p><a href=x>A lone link</a></p>{html([two])}</div></body>"
    assert extract.main_text(page) == "\n\n".join([one, "A lone link", two])
    links = "".join(f"<li><a href={k}>Some link</a></li>" for k in range(4))
    listed = f"<body><div>{html([one, two])}</div><ul>{links}<li>More.</li>{links}</ul></body>"
    assert extract.main_text(listed) == "\n\n".join([one, two])
    monkeypatch.setattr(extract, "SMOOTH_NEXT", 0)
    monkeypatch.setattr(extract, "SMOOTH_PARENT", 0)
    assert "A lone link" not in extract.main_text(page)
    assert "More." in extract.main_text(listed)


def test_wrappers_named_for_their_subject_keep_the_text():
    some = paragraphs(3)
    whole = "\n\n".join(some)
    assert extract.main_text(f'<body><div class="post legal-news reviews">{html(some)}</div></body>') == whole
    assert extract.main_text(f'<body><div class="reviews" id="discussion-1"><article>{html(some)}</article></div></body>') == whole
    assert extract.main_text(f"<body>{html(some[:1])}<article>{html(some[1:])}</article></body>") == whole
    assert extract.main_text(f"<body><main><p>Short one</p></main>{html(some)}</body>") == "Short one\n\n" + whole


def test_boilerplate_goes():
    some = paragraphs(3)
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><header><p>The masthead.</p></header>
    <div class="ad">Buy this now, it is very good.</div><article><h1>Title &amp; more</h1>{html(some)}<form><p>Sign up here.</p></form></article>
    <section class="comments"><p>{LONG} I say.</p><p>{LONG} So do I.</p></section><div class="cookie-notice"><p>We use cookies.</p></div><footer><p>{LONG}</p></footer><script>var x = "<p>no</p>"</script></body></html>"""
    assert extract.main_text(page) == "\n\n".join(["Title & more", *some])


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<p>a  b\n c&nbsp;d"), (None, "w", "<<p"), (5, "x", "<p>" + "word " * 20000 + "</p>")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extract.extract_pages(frame).collect()}
    assert got[1] == ("u", "", 0) and got[2] == (None, "", 0)
    assert got[3][1] == "a b c d"
    assert got[5][2] == 20000 * 5 - 1
    assert extract.extract_pages(frame.limit(0)).count() == 0
