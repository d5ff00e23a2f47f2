"""Secrets, pages, pieces, token files and WARC records: edge cases, round trips and brute force."""

import hashlib
import itertools
import json
import math
import re

import numpy as np
import pytest

from trailweave.llm import html, pieces, secrets, token_scan, warc

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, spans string"
ODD = [(1, None, "x"), (2, "", "x"), (3, "plain words only", "x"), (4, "é▁ \n\x00 𝒳 token=abc", "x"), (4, "é▁ \n\x00 𝒳 token=abc", "x"), (None, "no id", "x"), (6, "word " * 40_000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def test_base_secrets():
    hex_, key = "0123456789abcdef" * 2, "AKIA" + "A1" * 8
    text = f"é password: 'Tr0ub4dor&3x' token=short API-key api_key=abcdefgh {key} {hex_}f AKIA123 {hex_[:31]}"
    spans = secrets.scan(text)
    cut = {(k, text[a:b]) for k, a, b in spans}
    assert ("assign", "api_key=abcdefgh") in cut and ("access", key) in cut and ("hex", hex_ + "f") in cut
    assert ("guess", "Tr0ub4dor&3x") in cut and not any(k == "hex" and len(v) < 32 for k, v in cut) and len([k for k, _ in cut if k == "assign"]) == 2
    assert secrets.redact(text).count("[SECRET]") == 4 and secrets.scan("the ſecret=longenough12") == []


def test_guess_costs_are_minimal():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < 1 and cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("19870412") < 6
    assert cost("password") < cost("password1987") < cost("xK8#vQ2!pL9z") and cost("xK8#vQ2!pL9z") > 20

    def brute(text):
        best, n = float("inf"), len(text)
        known = {}
        for i in range(n):
            for j, c in secrets._Segments(text, secrets._RANK).at(i):
                known[i, j] = min(c, known.get((i, j), float("inf")))
        for cuts in itertools.product((0, 1), repeat=n - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
            total = sum(min(known.get((a, b), float("inf")), (b - a) * math.log10(secrets._alphabet(text))) for a, b in zip(at[:-1], at[1:]))
            best = min(best, total + secrets.NEXT * (len(at) - 2))
        return best

    for text in ("pass99x", "abcq1", "1999-01-01", "aaab", "Love12", "qwez", "ababab1", "zzzpass", "qazxcv12", "helloo", "passsssword"):
        assert abs(cost(text) - brute(text)) < 1e-9, text
        for enough in (1, 3, 6, 20):
            assert (cost(text, enough=enough) >= enough) == (cost(text) >= enough)


def test_segments_are_found_whole():
    found = {(i, j) for t in ["xpassword"] for i in range(len(t)) for j, _ in secrets._Segments(t, secrets._RANK).at(i)}
    assert (1, 9) in found and (1, 5) in found
    for text, whole in (("x" + "-" * 193, (1, 194)), ("9qwertyuiop", (1, 11)), ("Zabcdefgh", (1, 9)), ("1abcabcabc", (1, 10)), ("x19870412", (1, 9))):
        assert any((i, j) == whole for i in range(len(text)) for j, _ in secrets._Segments(text, secrets._RANK).at(i)), text
    assert secrets.guess_cost("-" * 193) < 5 and secrets.guess_cost("ab" * 5_000) < 9


def test_values_end_where_their_quotes_or_words_do():
    def values(text):
        return [text[a:b] for k, a, b in secrets.scan(text) if k == "guess"]

    assert values("pwd: xKqWzRtYpLmNbVcd") == ["xKqWzRtYpLmNbVcd"] and values("the passphrase is abqdkfuwhxzmqpoe.") == ["abqdkfuwhxzmqpoe"]
    assert values("password: Xy7$k(9Qz!pLm2") == ["Xy7$k(9Qz!pLm2"] and values("secret = 'a b[c]{d} Zq9!x' end") == ["a b[c]{d} Zq9!x"]
    assert values("http://h/?token=Zx81kkqPq91&user=1") == ["Zx81kkqPq91"] and values('{"password":"Zx81kkqPq91","u":1}') == ["Zx81kkqPq91"]
    assert values("password: password1") == [] and values("secret: " + "-" * 193) == [] and values("token: 'short'") == []


def test_words_are_learned_from_all_texts(spark):
    texts = [("the elephant password is kqzvwxjhtbfg",), ("an Elephant again, elephant2",), ("kqzvwx " * 2,), (None,)] * 2
    ranks = secrets.learned_words(spark.createDataFrame(texts, "text string"))
    assert ranks["elephant"] == 1 and ranks["password"] == 1 and "kqzvwxjhtbfg" not in ranks and ranks["kqzvwx"] == 2 and "again" not in ranks
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranks = secrets.learned_words(docs)
    common = [w for w, r in sorted(ranks.items(), key=lambda x: x[1]) if len(w) >= 6][:200]
    assert sum(secrets.guess_cost(w + "1", ranks) < secrets.LEAST_GUESSES for w in common) == len(common) == 200


def test_base_columns_equal_patterns_and_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: r for r in secrets.secrets(spark.read.parquet(path)).collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rows = duckdb.sql(f"""SELECT doc_id, coalesce(text, '') AS text,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS n_access,
        len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 32)) AS n_hex FROM '{path}'""").fetchall()
    assert len(rows) == len(got) and sum(r[2] + r[3] + r[4] for r in rows) > 20
    for doc_id, text, *counts in rows:
        spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and s[:5] != "guess"] == [s for s in listed.split(",") if s]


def test_secret_rows(odd):
    got = secrets.secrets(odd).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) and all(r.base_sha256 == none and r.spans == "" for r in got)
    assert sorted(map(str, (r.text for r in secrets.redacted(odd).collect()))) == sorted(str(r[1]) for r in ODD)
    assert secrets.secrets(odd.limit(0)).count() == 0 and secrets.redacted(odd.limit(0)).columns == odd.columns


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body class="x"><div id="cookie-notice">we use cookies a lot of them really</div><nav><ul><li><a href="/a">home of the long menu</a></li></ul></nav>
<div class="wrap-{n}"><div class="post-body c{n}"><h1>Head {n}</h1><p>First <b>bold</b>&nbsp;text &amp; more,<br>with a  line.<p>Second paragraph {n} goes on for some time.<script>if (a < b) x = "</p>";</script>
<form><input value="q">Search the site</form></div><div class="sidebar"><p>Popular posts of the side and other long things to read</p></div><div id="comments"><p>I as a reader say a whole lot about this</p></div></div><footer>&copy; us</footer></body></html>"""


def test_pages_by_consensus(spark):
    rows = [(i, f"http://Blog.Example.com:80/{i}", PAGE.format(n=i), "clash") for i in range(8)]
    rows += [(90, None, None, "clash"), (91, "x", "", "clash"), (92, "http://other.example/", "just text < 3 &lt;b&gt;", "clash"), (93, "http://blog.example.com/", "<p>no such path here", "clash"), (93, "http://blog.example.com/", "<p>no such path here", "clash"), (94, "http://z.example/", "<div>" * 3000 + "deep", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    paths = {r.host: r.path for r in html.consensus_paths(pages).collect()}
    assert paths["blog.example.com"].endswith("div.c.post-body")
    got = {}
    for r in html.main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(8):
        assert got[i] == [f"Head {i}\nFirst bold text & more, with a line.\nSecond paragraph {i} goes on for some time."]
    assert got[90] == [""] and got[91] == [""] and got[92] == ["just text < 3 <b>"] and got[93] == ["no such path here"] * 2 and got[94] == ["deep"]


def test_a_layout_word_does_not_drop_the_article(spark):
    body = "".join(f"<p>Paragraph {k} of the text goes on and on for a while.</p>" for k in range(6))
    want = "\n".join(["Title", *(f"Paragraph {k} of the text goes on and on for a while." for k in range(6))])
    comments = "<div id='comments'><article class='comment'>" + "<p>I say a lot more than the writer did, and then some more of it.</p>" * 9 + "</article></div>"
    for name in ("has-sidebar", "no-sidebar", "side-by-side", "header-fixed", "comments-open", "sidebar", "widget-area", "Header", "comments"):
        for inner in ("<div>{}</div>", "<article>{}</article>", "{}"):
            page = f"<html><body><nav>menu of it</nav><div class='{name}'>{inner.format('<h1>Title</h1>' + body)}<div class='sidebar'><p>popular things</p></div></div><div class='footer'>foot</div></body></html>"
            assert html.extract(page, None) == want, (name, inner)
    for article in ("<article>{}</article>", "<div class='post'>{}</div>"):
        page = f"<body>{article.format('<h1>Title</h1>' + body)}{comments}</body>"
        assert html.extract(page, None) == want, article


def test_the_consensus_decides_where_a_page_alone_would_not(spark):
    # One page has more prose in a box that no name gives away than in its text; the others of its host tell which is which.
    def page(text, box):
        return f"<body><div class='a{{}}'><p>{text}</p></div><div class='b'><p>{box}</p></div></body>"

    rows = [(i, f"http://h/{i}", page(f"the story number {i} goes on for a long while here", "about us")) for i in range(6)]
    odd = page("short one", "about us and all of our very many long and interesting things")
    rows += [(6, "http://h/6", odd), (7, "http://alone/", odd)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6] == "short one" and got[7].startswith("about us and all") and got[0] == "the story number 0 goes on for a long while here"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_articles():
    from trailweave.llm.html import extract

    words = lambda n, k=0: " ".join(f"word{k + i}" for i in range(n)) + "."
    # a title beside the winning container
    assert extract(f"<body><div><h1>Title</h1><div class='post-content'><p>{words(80)}</p></div></div></body>", None) == f"Title\n{words(80)}"
    assert extract(f"<body><header><h1>Site</h1></header><div class='post-content'><p>{words(80)}</p></div></body>", None) == words(80)
    assert extract(f"<body><h1>Site</h1><div class='post-content'><h1>Own</h1><p>{words(80)}</p></div></body>", None) == f"Own\n{words(80)}"
    # an article in two containers
    assert extract(f"<body><div class='x'><div class='first'><p>{words(80)}</p></div><div class='rest'><p>{words(20, 100)}</p></div></div></body>", None) == f"{words(80)}\n{words(20, 100)}"
    # names with other meanings inside an article
    start = f"<p>{words(120)}</p>"
    for name in ("related-work", "discussion", "share-price", "side-effects", "legal", "copyright-law"):
        part = f"<section class='{name}'><h2>Part</h2><p>{words(20, 200)}</p></section>"
        assert extract(f"<body><article>{start}{part}</article></body>", None) == f"{words(120)}\nPart\n{words(20, 200)}", name
    assert extract(f"<body><article>{start}<div class='header'><h2>Methods</h2></div><p>{words(20)}</p></article></body>", None) == f"{words(120)}\nMethods\n{words(20)}"
    # but menus, adverts, comments and boxes of links go
    for box in (
        "<div class='related-posts'><h3>Related posts</h3><a href=x>One more story that you may like to read.</a></div>", "<div class='share-buttons'>Share Tweet</div>", "<div class='ad'>Shoes at half their price, today and only here in our shop.</div>",
        "<div class='newsletter-signup'>Sign up for our letter and never miss a story again.</div>", "<div class='comments-area'><p>I don't agree with the writer at all, as I said before.</p></div>", "<div id='respond'>Leave a reply to what has been said above, if you like.</div>",
    ):
        assert extract(f"<body><article>{start}{box}</article></body>", None) == words(120), box


def test_empty_pages_table(spark):
    from trailweave.llm.html import main_text

    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_deep_pages_take_linear_time():
    import time

    deep = "".join(f"<div>words of level {k}" for k in range(20_000))
    began = time.process_time()
    text = html.extract(deep, None)
    assert time.process_time() - began < 5 and "words of level 19999" in text
    spans = "<span>" * 20_000 + "".join(f"<div>x{k}</p></b>" for k in range(2_000))
    began = time.process_time()
    html.extract(spans, None)
    assert time.process_time() - began < 5


def tiny():
    words = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb"]
    scores = [-5.0, -6.0, -4.0, -4.5, -7.0, -3.0, -2.0, -2.5, -9.0]
    byte = [f"<0x{i:02X}>" for i in range(256)]
    texts = ["<unk>", *words, *byte]
    return pieces.Pieces.of({w: (i + 1, s) for i, (w, s) in enumerate(zip(words, scores))}, texts, list(range(len(words) + 1, len(texts))), 0)


def test_n_best_equal_brute_force():
    p = tiny()

    def brute(marked, at=0):
        if at == len(marked):
            return [(0.0, ())]
        out = []
        for end in range(at + 1, len(marked) + 1):
            if piece := p.known.get(marked[at:end]):
                out += [(piece[1] + s, (piece[0], *ids)) for s, ids in brute(marked, end)]
        return out

    for n in range(1, 8):
        for text in map("".join, itertools.product("ab ", repeat=n)) if n < 6 else ["abababa", "ab abba", "aab bab"]:
            want = sorted((s for s, _ in brute("▁" + text.replace(" ", "▁"))), reverse=True)[:4]
            for found in (p.encode(text, 4), [(s, np.array(i, dtype=np.int32).tobytes()) for s, i in p.n_best("▁" + text.replace(" ", "▁"), 4)]):
                assert np.allclose([s for s, _ in found], want) and len({i for _, i in found}) == len(found)
                assert all(p.decode(ids) == text for _, ids in found)


def test_many_words_at_once_equal_the_search():
    rng = np.random.default_rng(9)
    for p, letters in ((tiny(), "ab"), (pieces.Pieces.load(open(pieces.MODEL, "rb").read()), "aeinrstéΩ字.")):
        words = sorted({"▁" * int(rng.integers(0, 3)) + "".join(rng.choice(list(letters), rng.integers(1, 14))) for _ in range(400)})
        for w, (score, ids, gap) in zip(words, p.viterbi(words), strict=True):
            best = p.n_best(w, 2)
            assert (score, ids) == (best[0][0], np.array(best[0][1], dtype=np.int32).tobytes()), w
            assert gap == (best[0][0] - best[1][0] if len(best) > 1 else float("inf")), w


def test_pieces_round_trip(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    got = pieces.segmentations(docs.unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)).collect()
    assert len(got) == docs.count() + len(ODD)
    assert all(r.round_trip for r in got if r.n_pieces is not None and r.doc_id != 4)  # a text that holds the mark itself doesn't come back
    assert sum(r.n_pieces is None for r in got) == 1 and all(r.second_score <= r.best_score for r in got if r.second_score is not None)
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert {(r.doc_id, r.text) for r in back} == {(r.doc_id, r.text) for r in docs.collect()}


def test_registered_columns_equal_brute_force(spark, tmp_path):
    """Rows by rank and digests, from the search by hand over the model's own pieces."""
    p = pieces.Pieces.load(open(pieces.MODEL, "rb").read())

    def brute(text, n):
        # All segmentations of each word, merged into the text's n best.
        best = [(0.0, ())]
        for word in pieces._WORD.findall("▁" + text.replace(" ", "▁")):
            ways = {0: [(0.0, ())]}
            for j in range(1, len(word) + 1):
                found = [(s + score, i + got) for a, score, got in p._ends(word)[j] for s, i in ways[a]]
                ways[j] = sorted(found, key=lambda x: -x[0])[:n]
            best = sorted([(s + t, i + k) for s, i in best for t, k in ways[len(word)]], key=lambda x: -x[0])[:n]
        return best

    texts = ["the quick brown fox", "Überraschung für é字", "a", "", None, "x" * 700 + " tail", "the quick brown fox"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, rank string")
    rows = {}
    for r in pieces.ranked(docs, 4).collect():
        rows.setdefault(r.doc_id, []).append((r.rank, r.score, r.ids))
    assert set(rows) == {0, 1, 2, 5, 6}
    for i in (0, 1, 2, 6):
        want = brute(texts[i], 4)
        assert [r for r, _, _ in rows[i]] == list(range(1, len(want) + 1)) and np.allclose([s for _, s, _ in rows[i]], [s for s, _ in want])
        assert all(p.decode(ids) == texts[i] and math.isclose(score, sum(dict((q[0], q[1]) for q in p.known.values()).get(x, 0) for x in ids), abs_tol=1e-6) for _, score, ids in rows[i] if not any(x in p.of_byte for x in ids))
    got = {r.doc_id: r for r in pieces.segmentations(docs, n=4).collect()}
    digest = lambda ids: hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()
    for i, found in rows.items():
        assert got[i].ids_sha256 == digest(found[0][2]) and got[i].n_pieces == len(found[0][2]) and got[i].best_score == found[0][1]
        assert (got[i].second_sha256, got[i].second_score) == ((digest(found[1][2]), found[1][1]) if len(found) > 1 else (None, None)) and got[i].round_trip
    assert (got[3].n_pieces, got[3].best_score, got[3].second_score, got[3].ids_sha256) == (0, 0.0, None, digest([])) and got[4][1:] == (None,) * 6
    both = {r.doc_id: (r.ids, r.other_ids) for r in pieces.encoded(docs.withColumn("lang", docs.rank).withColumn("source", docs.rank)).collect()}
    assert all(both[i][0] == f[0][2] and both[i][1] == (f[1][2] if len(f) > 1 else None) for i, f in rows.items()) and both[3] == ([], None) and both[4] == (None, None)
    assert pieces.segmentations(docs.limit(0)).count() == 0 and pieces.ranked(docs.limit(0)).count() == 0


def test_token_files_are_counted_across_blocks(spark, odd, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_scan.RANKS, "rb"))}
    whole = tiktoken.Encoding("whole", pat_str=token_scan.PATTERN, mergeable_ranks=ranks, special_tokens={})
    order = token_scan.write_tokens(odd.repartition(3), str(tmp_path / "t")).collect()
    for block in (7, 64, 1 << 20):
        got = {(r.file, r.ordinal): r.n_tokens for r in token_scan.scan_tokens(spark, str(tmp_path / "t"), block=block).collect()}
        assert len(got) == len(order) == len(ODD)
        counts = sorted((str(r.doc_id), got[r.file, r.ordinal]) for r in order)
        assert counts == sorted((str(i), len(whole.encode_ordinary(t or ""))) for i, t, _ in ODD)
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.bin").write_bytes(np.array([5, token_scan.END, token_scan.END, 6, 7], dtype="<u2").tobytes() + b"\x01")
    rows = [(r.start, r.n_tokens, r.closed) for r in token_scan.scan_tokens(spark, str(tmp_path / "u"), block=2).orderBy("ordinal").collect()]
    assert rows == [(0, 1, True), (2, 0, True), (3, 2, False)]
    assert token_scan.token_counts(odd.limit(0)).count() == 0 and token_scan.token_counts(odd).count() == len(ODD)


def test_warc_derivatives_link_and_keep(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<title>A &amp; B</title><p>Hé <a href='/x'>link</a>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = {(r.key, r.record_id): r for r in warc.responses(pages).collect()}
    got = warc.serialised(warc.derivatives(warc.responses(pages))).collect()
    assert len(got) == 6 and sorted(r.record_type for r in got) == ["conversion"] * 3 + ["metadata"] * 3
    for r in got:
        body, of = r.body.encode(), source[r.key, r.refers_to]
        assert r.content_length == len(body) and r.block_digest == warc.digest(body) and f"WARC-Refers-To: {of.record_id}" in r.headers
        payload = of.block.partition("\r\n\r\n")[2].encode()
        assert r.source_payload_digest == of.payload_digest == warc.digest(payload) and of.block_digest == warc.digest(of.block.encode())
        assert any(o.record_id == r.concurrent_to and o.refers_to == r.refers_to for o in got)
        assert bytes(r.record).startswith(b"WARC/1.0\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
    one = {r.record_type: r for r in got if r.key == 1}
    about = json.loads(one["metadata"].body)["Envelope"]
    assert about["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"] == {"Title": "A & B", "Links": [{"path": "A@/href", "url": "/x"}]}
    assert ["WARC-Record-ID", one["metadata"].refers_to] in about["WARC-Header-Metadata"] and one["conversion"].body == "Hé link"
    assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", one["metadata"].record_id)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_new_words_are_found_without_going_over_the_remembered():
    class Known(dict):
        def keys(self):
            raise AssertionError("all remembered words")

    p = tiny()
    p.remembered = Known()
    texts = ["ab ba", None, "", "ba abb"]
    words = p.learn(texts)
    assert words == p.learn(texts) and [len(w) for w in words] == [2, 0, 0, 2]
    for t, w in zip(texts, words, strict=True):
        assert t is None or p.encode(t, 3, w) == p.encode(t, 3) == tiny().encode(t, 3)
    assert p.remembered and p.left
    p.forget()
    assert not p.remembered and not p.left
