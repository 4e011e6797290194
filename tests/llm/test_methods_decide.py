"""That the named methods decide something, and decide it better than what stands beside them."""

import base64
import random
import string
import time

from tidemark.llm import html_extract, secrets, token_counts, url_filter

SENTENCE = "What the people of the town had seen on that day was told again and again, and each time a little was added to it."
WORDS = SENTENCE.lower().replace(",", "").replace(".", "").split()


def _paragraph(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(rng):
    """(html, [(text, is content)]): no article element; short lines of dialogue among paragraphs, plain items among link lists."""
    blocks = []
    parts = ["<html><body><div>"]
    for i in range(rng.randint(4, 9)):
        text, href = f"Item {rng.randrange(10 ** 6)} {_paragraph(rng, 3)}", f"/x/{i}"
        plain = 0 < i < 8 and rng.random() < 0.25
        parts.append(f"<p>{text}</p>" if plain else f"<p><a href='{href}'>{text}</a></p>")
        blocks.append((text, False))
    parts.append("</div><div>")
    for _ in range(rng.randint(5, 10)):
        text = _paragraph(rng, rng.choice([1, 2, 3, 30, 50, 70])) + f" {rng.randrange(10 ** 6)}"
        parts.append(f"<p>{text}</p>")
        blocks.append((text, True))
    return "".join([*parts, "</div></body></html>"]), blocks


def test_the_cut_improves_on_its_classifier():
    rng = random.Random(3)
    alone = cut = changed = total = 0
    for _ in range(150):
        page, truth = _page(rng)
        blocks = html_extract.blocks_of(page)
        assert [b.text for b in blocks] == [t for t, _ in truth]
        scores = [html_extract.content_score(b) for b in blocks]
        kept = html_extract.minimum_cut(scores, html_extract.ties(blocks))
        alone += sum((s > 0) == t for s, (_, t) in zip(scores, truth, strict=True))
        cut += sum(k == t for k, (_, t) in zip(kept, truth, strict=True))
        changed += sum((s > 0) != k for s, k in zip(scores, kept, strict=True))
        total += len(truth)
    assert changed > 0.05 * total and cut > alone and cut / total > 0.95


def test_the_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, B905, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2 ** n))
        assert abs(cost(html_extract.minimum_cut(scores, edges)) - best) < 0.01


def test_pages_that_lost_text():
    text = html_extract.main_text
    assert text('<article><p class=x">First one.</p><p>Second.</p></article>') == "First one.\nSecond."
    assert text(f"<body><div><p>Yes.</p><p>No, he said.</p><p>{SENTENCE * 2}</p><p>Why?</p></div></body>").count("\n") == 3
    for c in ("article-comments", "post-nav", "entry-footer", "content-sidebar", "story-related"):
        assert text(f'<div class="content"><p>{SENTENCE}</p></div><div class="{c}"><p>{SENTENCE} Not this.</p></div>') == SENTENCE
    assert text(f'<main class="content has-sidebar"><div class="post-header"><h1>Title</h1></div><p>{SENTENCE}</p></main>') == f"Title\n{SENTENCE}"
    assert "Bake the cookies" in text(f"<div><p>{SENTENCE}</p><p>Bake the cookies for ten minutes.</p><p>{SENTENCE}</p></div>")
    assert "use cookies" not in text(f"<article><p>{SENTENCE}</p></article><p>We use cookies. Accept cookies?</p>")


def test_long_broken_pages_take_linear_time():
    for piece in ("</b>", "<b>", "<h1>", "<p>x", "<div>x", "<a href=x>y", "<li>x", '<p><b class="x>y</i>'):
        start = time.time()
        html_extract.main_text(piece * 50_000)
        assert time.time() - start < 8, piece


def _drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_planted_secrets_are_found_and_names_left_alone():
    rng = random.Random(12)
    b64 = lambda n: base64.b64encode(bytes(rng.getrandbits(8) for _ in range(n))).decode()
    mixed = string.ascii_letters + string.digits
    kinds = {
        "pem": lambda: ("-----BEGIN PRIVATE KEY-----\n", f"{b64(48)}\n{b64(48)}"), "letters": lambda: ("client secret is ", _drawn(rng, string.ascii_letters, 26)),
        "next line": lambda: ("credentials:\n  key:\n    ", _drawn(rng, mixed, 32)), "bearer": lambda: ("Authorization: Bearer ", base64.urlsafe_b64encode(b64(30).encode()).decode()),
        "environment": lambda: ("export AWS_SESSION_KEY=", _drawn(rng, mixed + "+/", 40)), "prose": lambda: ('the private signing key we use is "', _drawn(rng, mixed + "-_", 36))}
    for name, made in kinds.items():
        hits = lines = 0
        for _ in range(60):
            before, secret = made()
            text = f"{_paragraph(rng, 60)}\ndef handler(request):\n    {before}{secret}\n{_paragraph(rng, 40)}"
            at = text.index(secret)
            base = secrets.base_spans(text)
            spans = base + secrets.novel_spans(text, base)
            hits += any(a < at + len(secret) and at < b for a, b, _ in spans)
            lines += all(any(a < at + k < b for a, b, _ in spans) for k in (5, len(secret) - 5))
        assert hits >= 54, name
        assert name != "pem" or lines >= 50  # every line of a key
    clean = ["The token is passed to getUserAuthenticationToken and to org.example.security.AuthenticationProvider.", "secret_manager_service_client_configuration_provider = None",
             "session overview: https://example.com/docs/authentication/session-management/overview-2023", "private static final TransactionAttributeSourcePointcut2 pointcut",
             "secret: Donaudampfschifffahrtsgesellschaftskapitaen", "The private key is in /etc/ssl/private/server-certificate-2048-bits.pem", "api key: xxxxxxxxxxxxxxxxxxxxxxxx",
             "session expires 2024-01-01T00:00:00Z, token 00000000000000000000", *(f"password {_paragraph(rng, 80)}" for _ in range(50))]
    assert not [t for t in clean if secrets.novel_spans(t, secrets.base_spans(t))]
    words = "secret " + "\n".join(f"password={_drawn(rng, mixed, 24)} {_drawn(rng, mixed, 30)}" for _ in range(4000))
    start = time.time()
    found = secrets.novel_spans(words, secrets.base_spans(words))
    assert time.time() - start < 10 and len(found) > 3500


def test_url_models_leave_harmless_words_alone(spark):
    pages = [f"https://www.{a}{b}.org/{c}/{i}" for i in range(12) for a, b, c in (("radio", "north", "news"), ("library", "hall", "books"), ("city", "garden", "en"))]
    bad = [f"https://www.{a}-{b}.example/win/{i}" for i in range(8) for a, b in (("casino", "royal"), ("poker", "nights"), ("casino", "slots"))]
    asked = [f"https://radio{i}.org/music/soundtrack-{i}" for i in range(10)] + [f"https://track.racing{i}.org/results" for i in range(10)]
    urls = pages + bad + asked
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules=()).collect()}
    verdict = {u: got[i] for i, u in enumerate(urls)}
    assert {verdict[u] for u in bad} == {"block"} and {verdict[u] for u in pages + asked} == {"allow"}


def test_frequent_pre_tokens_are_met_in_the_first_tier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    packed = token_counts.frequent_lengths(docs.where("doc_id % 10 <> 3"))
    tier = {line[1:].decode() for line in packed.split(b"\n")}
    assert len(tier) <= token_counts.FREQUENT and max(len(t.encode()) for t in tier) <= token_counts.LONGEST
    seen = [t for r in docs.where("doc_id % 10 = 3").select("text").collect() for t in token_counts.pre_tokens(r.text or "")]
    assert sum(t in tier for t in seen) / len(seen) >= 0.9
