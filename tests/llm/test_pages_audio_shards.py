import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import audio, html, queries, sharding, warc

PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a>x</a></ul></nav>{}<footer>&copy; z</footer>"


def extract(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit("clash"))
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(df).collect()}


def test_main_text(spark):
    pages = [
        (1, "http://a.example/1", PAGE.format("<!-- ad --><div class='ad'>buy</div><article><h1>One &amp; two</h1><p><b>First  line<br><p>Second&nbsp;line</article>")),
        (2, "http://a.example/2", PAGE.format("<article><h1>Other</h1><ul><li>i<li>j</ul><form>f</form><div class=comments><p>no</p></div></article>")),
        (3, "http://b.example/3", "<div id=menu>m</div><div><p>Plain <i>it</i>alic</p></div><div class='side bar sidebar'>s</div>"),
        (4, "http://b.example/4", None), (5, None, "just text &#233; <"), (6, "odd", ""), (7, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 3000), (8, "http://c.example/x", "<p>" + "long " * 50_000),
    ]
    got = extract(spark, pages + pages[:1])
    assert got[1] == ("One & two\nFirst line\nSecond line", 32)
    assert got[2][0] == "Other\ni\nj" and got[3][0] == "Plain italic" and got[4] == ("", 0)
    assert got[5][0] == "just text é <" and got[6] == ("", 0) and got[7][0] == "deep" and got[8][1] == 5 * 50_000 - 1
    assert extract(spark, []) == {}


def test_article_is_told_by_page(spark):
    """One page with an article element must not empty the host's other templates."""
    got = extract(spark, [(1, "http://m.example/1", "<article><p>one</p></article><div>menu of one</div>"), (2, "http://m.example/2", "<div class=content><p>two</p></div><div>rest</div>"), (3, "http://m.example/3", "<div><p>three</p></div>"), (4, "http://m.example/4", "<main></main><div class=post>four</div>")])
    assert {k: v[0] for k, v in got.items()} == {1: "one", 2: "two", 3: "three", 4: "four"}


def test_deep_nesting_keeps_ancestors_and_outsides(spark):
    deep = "<div><article><p>before</p>" + "<div>" * 5000 + "in" + "</div>" * 5000 + "<p>after</p></article></div>"
    outsides = "<div>" * 300 + "<p>text</p><nav>menu</nav><div class=ad>buy</div>" + "</div>" * 300
    open_ended = "<article>" + "<section>" * 20_000 + "x" + "</nothing>" * 20_000 + "<aside>no</aside>"
    got = extract(spark, [(k, f"http://d.example/{k}", p) for k, p in enumerate([deep, outsides, open_ended])])
    assert got[0][0] == "before\nin\nafter" and got[1][0] == "text" and got[2][0] == "x"


def test_wrappers_generalise():
    page = lambda text: html.parse(text)
    body = html.generalise([page("<div><h1>a</h1><p>b</p><p>c</p></div>"), page("<div><h1>a</h1><table></table><p>b</p></div>")]).kids[0]
    assert [(c.label, c.flags) for c in body.kids] == [("h1", ""), ("table", "?"), ("p", "+")]
    groups = html.generalise([page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p>"), page("<h2>a</h2><p>b</p><ul><li>i</ul>")])
    assert [(c.label, c.flags, [(k.label, k.flags) for k in c.kids if k.label != "li"]) for c in groups.kids] == [("(h2|p)", "+", [("h2", ""), ("p", "+")]), ("ul", "?", [])]
    assert html.dump(html.load(html.dump(groups))) == html.dump(groups)


def test_alignment_of_lists_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (["abcde"[k] for k in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2))
        pairs = html.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]
    long = [str(k % 700) for k in range(3000)]
    assert len(html.common(long, long[::2])) == 1500


def regex(node):
    """The union-free regular expression of a wrapper over the labels of a page."""
    inner = "".join(map(regex, node.kids))
    inner = inner if node.label.startswith("(") else f"<{node.label}>{inner}</>"
    return "(?:" + inner + ")" + {"": "", "+": "+", "?": "?", "?+": "*"}[node.flags]


def spelled(node):
    return f"<{node.label}>" + "".join(map(spelled, node.kids)) + "</>"


def test_wrappers_accept_their_pages():
    """Brute force: a host's wrapper, spelled out as a regular expression, matches every page it was made from."""
    import re

    rng = np.random.default_rng(8)
    for _ in range(60):
        made = []
        for _ in range(4):
            parts = [["<p>t</p>", "<h2>t</h2>", "<ul><li>t<li>u</ul>", "<div>t<p>u</p></div>"][k] for k in rng.integers(0, 4, rng.integers(0, 7))]
            made.append("<div>" + "".join(parts) + "</div>")
        wrapper = html.generalise([html.parse(m) for m in made])
        pattern = re.compile(regex(wrapper))
        found = [bool(pattern.fullmatch(spelled(html.parse(m)))) for m in made]
        assert all(found), (made, html.dump(wrapper))


def test_no_order_or_partition_drops_text(spark):
    pages = ["<h1>t</h1><div class=x><p>body</p></div>", "<div class=x><p>hello main</p></div>", "<div class=x><ul><li>lst</li></ul></div><h1>t</h1><div class=x><p>b</p></div>"]
    rows = [(k, "http://o.example/", p) for k, p in enumerate(pages)]
    found = {str(sorted(extract(spark, r).items())) for r in (rows, rows[::-1], [rows[1], rows[2], rows[0]])}
    assert len(found) == 1 and "hello main" in found.pop()


def test_slots_find_the_article_without_helpful_names(spark):
    page = "<div class=a1><div class=b7>The Daily Site</div><div class=q><a href=/>One</a> <a>Two</a></div><div class=zz>{}<div class=k3>Write to us</div></div><div class=g>Copyright 2020</div></div>"
    bodies = ["".join(f"<h2>Part</h2><p>{'word ' * 30}of {k} and {n}</p>" for n in range(k + 1)) for k in range(5)]
    got = extract(spark, [(k, "http://slots.example/x", page.format(b)) for k, b in enumerate(bodies)])
    for k in range(5):
        assert got[k][0] == "\n".join(f"Part\n{'word ' * 30}of {k} and {n}" for n in range(k + 1))
    alone = extract(spark, [(9, "http://alone.example", page.format(bodies[1]))])
    assert "Write to us" in alone[9][0] and "Part" in alone[9][0]


def test_large_sets_of_wrappers_are_joined(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/", f"<article><p>text {k}</p></article><div>x</div>") for k in range(30)]
    whole = extract(spark, rows)
    monkeypatch.setattr(html, "BROADCAST_CHARS", -1)
    assert extract(spark, rows) == whole and whole[4][0] == "text 4"


def test_inline_elements_named_as_outside(spark):
    got = extract(spark, [(1, "http://i.example", "<article><p>a <span class=ad>buy <span>x</span> now</span> b</p><p>c<a class=share>s</a></article>")])
    assert got[1][0] == "a b\nc"


def test_wrapper_join_rounds(spark):
    pages = spark.createDataFrame([(i, "http://h.example", f"<div><p>a</p>{'<table></table><p>b</p>' * (i % 7)}</div>") for i in range(60)], "page_id long, url string, html string").repartition(12)
    assert html.wrappers(pages.withColumn("host", F.lit("h")), fan_in=3).count() == 1
    assert html.main_text(pages).where("page_id = 6").first()["text"].count("b") == 6


def test_extraction_query_equals_the_article_of_every_page(spark):
    """Brute force on the given pages: their article element, tags cut out, blocks as the tags of blocks leave them."""
    import html as entities
    import re

    sf = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in queries.op7_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    for p in pages:
        inner = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        cuts = re.split("</?(?:p|h1|ul|li|div|h2)[^>]*>", inner)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", c)).split()) for c in cuts]
        text = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == text and got[p["page_id"]]["n_chars"] == len(text) and got[p["page_id"]]["url"] == p["url"]
    assert len(got) == len(pages)


def tones(seed, n=40_000):
    rng = np.random.default_rng(seed)
    steps = np.repeat(rng.choice(220 * 2 ** (np.arange(24) / 12), n // 1000), 1000)
    return np.sin(2 * np.pi * np.cumsum(steps) / 8000) * 90


def recording(signal):
    return bytes(np.clip(signal + 128, 0, 255).astype(np.uint8))


def test_alignment(spark):
    rng = np.random.default_rng(9)
    a, b = tones(1), tones(2)
    rows = [(1, recording(a)), (2, recording(a)), (3, recording(a + rng.normal(0, 1.5, len(a)))), (4, recording(a[64 * 40 :])), (5, recording(b)), (6, b""), (7, None), (8, recording(b[:1000]))]
    df = spark.createDataFrame(rows, "doc_id long, audio binary").withColumn("codes", F.lit("clash"))
    got = {r["doc_id"]: r for r in audio.align(df).collect()}
    assert [got[i]["class_id"] for i in (1, 2, 3, 4)] == [1] * 4 and [got[i]["class_id"] for i in (5, 6, 7, 8)] == [5, 6, 7, 8]
    assert got[4]["aligned_to"] == 1 and got[4]["offset"] == 40 and got[4]["bit_errors"] < 0.05 and got[6]["codes"] == []
    assert audio.align(df.limit(0)).count() == 0


def test_excerpts_of_a_long_recording_and_members_that_fail_the_centre(spark):
    long = tones(11, 400_000)
    cuts = [(i, recording(long[64 * k : 64 * k + 4_000])) for i, k in enumerate(range(100, 6000, 600), 10)]
    shared = [tones(k, 12_000) for k in (21, 22, 23)]
    opening = tones(31, 6_000)
    # all open alike; only the last two go on alike, and each is of its own length
    same = [(50, recording(np.concatenate([opening, shared[0], tones(41, 30_000)]))), (51, recording(np.concatenate([opening, shared[1]]))), (52, recording(np.concatenate([opening, shared[1], tones(42, 14_000)])))]
    crowd = [(60 + k, recording(np.concatenate([opening, tones(60 + k, 30_000)]))) for k in range(30)]
    got = {r["doc_id"]: r for r in audio.align(spark.createDataFrame([(9, recording(long)), *cuts, *same, *crowd], "doc_id long, audio binary")).collect()}
    assert [got[i]["class_id"] for i, _ in cuts] == [9] * len(cuts) and got[10]["offset"] == 100
    assert got[50]["class_id"] == 50 and got[51]["class_id"] == got[52]["class_id"] == 51


def brute_links(codes, errors=0.15, overlap=0.5):
    """All pairs of recordings (id to codes) that have a run in common, by the definition."""
    from collections import Counter

    out = {}
    ids = sorted(codes)
    starts = {i: [codes[i][k : k + audio.RUN].tobytes() for k in range(len(codes[i]) - audio.RUN + 1)] for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if set(starts[a]).isdisjoint(starts[b]):
                continue
            votes = Counter(q - p for p, x in enumerate(starts[a]) for q, y in enumerate(starts[b]) if x == y)
            offset = max(votes, key=lambda o: (votes[o], -abs(o), -o))
            x, y = codes[a][max(0, -offset) :], codes[b][max(0, offset) :]
            both = min(len(x), len(y))
            if both >= overlap * min(len(codes[a]), len(codes[b])) and np.bitwise_count(x[:both] ^ y[:both]).sum() <= errors * 32 * both:
                out[a, b] = offset
    return out


def classes(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def codes_of(sound):
    return audio.fingerprint(np.frombuffer(sound, np.uint8) - 128.0)


def test_classes_of_the_query_equal_all_pairs(spark):
    """Recall of the whole search against brute force: every linked pair of the given table is in one class."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op3_chroma_fingerprints(spark, sf).collect()}
    sounds = {r["doc_id"]: codes_of((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = {}
    for i in sorted(sounds):
        first.setdefault(sounds[i].tobytes() or i, i)
    distinct = {i: sounds[i] for i in first.values() if len(sounds[i])}
    links = brute_links(distinct)
    of_first = classes(first.values(), links)
    assert len(links) > 5 and {i: r["class_id"] for i, r in got.items()} == {i: of_first[first[sounds[i].tobytes() or i]] for i in sounds}


@pytest.mark.parametrize("few", [2, 4, 16])
def test_recall_in_crowds(spark, monkeypatch, few):
    """Noisy excerpts of a few recordings that all open alike, so that lists are long: classes equal all pairs'."""
    monkeypatch.setattr(audio, "FEW", few)
    rng = np.random.default_rng(4)
    opening = tones(70, 5_000)
    whole = [np.concatenate([opening, tones(71 + k, 30_000)]) for k in range(4)]
    sounds = {}
    for i in range(60):
        base = whole[i % 4]
        start = int(rng.integers(0, 8)) * 64
        sounds[i] = recording(base[start : start + int(rng.integers(6_000, 30_000))] + rng.normal(0, 0.2, 1)[0])
    got = {r["doc_id"]: r["class_id"] for r in audio.align(spark.createDataFrame(list(sounds.items()), "doc_id long, audio binary")).collect()}
    codes = {i: codes_of(s) for i, s in sounds.items()}
    links = brute_links(codes)
    together = np.mean([got[a] == got[b] for a, b in links])
    wrong = [(a, b) for a in got for b in got if a < b and got[a] == got[b] and classes(codes, links)[a] != classes(codes, links)[b]]
    assert len(links) > 300 and together >= 0.9 and not wrong


def test_no_pair_of_a_long_list_is_missed(spark, monkeypatch):
    """All open alike. Excerpts that end ever later: those of some length are linked to their neighbours, and whom the
    smallest id verifies may be the only link of one that it does not. Blocks are far shorter than the lists."""
    monkeypatch.setattr(audio, "BLOCK", 8, raising=False)
    opening = tones(80, 4_000)
    sounds = {}
    for family in range(6):
        parts = [tones(90 + 10 * family + k, 3_000) for k in range(6)]
        for k in range(6):
            mixed = [p if n < k else tones(500 + 10 * family + n, 3_000) for n, p in enumerate(parts)]
            sounds[10 * family + (3 * k + 2) % 7] = recording(np.concatenate([opening, *mixed]))
    sounds |= {100 + k: recording(np.concatenate([opening, np.zeros(5_000 + 700 * k)])) for k in range(4)}  # one run over and over
    codes = {i: codes_of(x) for i, x in sounds.items()}
    got = {r["doc_id"]: r["class_id"] for r in audio.align(spark.createDataFrame(list(sounds.items()), "doc_id long, audio binary")).collect()}
    links = brute_links(codes)
    assert len(links) > 10 and got == classes(codes, links)


def test_the_shorter_recording_travels(spark, monkeypatch):
    """Cuts of one long recording are compared with it by sending it the cuts, whichever has the smaller id."""
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(0, 256, 12_000, np.uint8))
    sounds = {5: long, 1: long[:7168], 9: long[640:8000]}
    met, plain = [], audio.write

    def spy(df):
        done = plain(df)
        if set(df.columns) == {"less", "more"}:
            met.extend((r["less"], r["more"]) for r in done.df.collect())
        return done

    monkeypatch.setattr(audio, "write", spy)
    got = {r["doc_id"]: r for r in audio.align(spark.createDataFrame(list(sounds.items()), "doc_id long, audio binary")).collect()}
    sizes = {i: len(r["codes"]) for i, r in got.items()}
    assert met and all(sizes[a] <= sizes[b] for a, b in met)
    assert {r["class_id"] for r in got.values()} == {1}


def test_histograms_equal_direct_counts(monkeypatch):
    rng = np.random.default_rng(3)
    for most in (1 << 20, 50):
        monkeypatch.setattr(audio, "MEETINGS", most)
        for _ in range(20):
            x, y = (np.repeat(rng.integers(0, 3, 12), rng.integers(1, 9, 12)).astype(np.uint32) for _ in range(2))
            a, b = audio.runs(x, audio.RUN), audio.runs(y, audio.RUN)
            direct = np.zeros(len(a) + len(b) + 1, np.int64)
            for p, u in enumerate(a):
                direct[np.flatnonzero(b == u) - p + len(a)] += 1
            assert (audio.histogram(x, y) == direct).all()


def test_filters_equal_direct_sums():
    """Every code against sums over the frames themselves, filter by filter."""
    frames = audio.chroma(tones(3), audio.Settings())
    assert frames.shape[1] == 12 and np.allclose(np.square(frames).sum(axis=1), 1)
    got = audio.fingerprint(tones(3))
    assert len(got) == len(frames) - audio.SPAN + 1
    for at in range(0, len(got), 37):
        code = 0
        for kind, y, height, width in audio.FILTERS:
            area = frames[at : at + width, y : y + height]
            t, p = np.arange(width)[:, None], np.arange(height)[None]
            late, high = t >= width // 2, p >= height // 2
            inner_t, inner_p = (t >= width // 3) & (t < width - width // 3), (p >= height // 3) & (p < height - height // 3)
            side = {1: high & (t >= 0), 2: late & (p >= 0), 3: late == high, 4: inner_p & (t >= 0), 5: inner_t & (p >= 0)}.get(kind)
            if kind == 0:
                one, other = area.mean(), 12**-0.5
            else:
                one, other = area[side].sum(), area[~side].sum() / (2 if kind > 3 else 1)
            value = np.log((1e-3 + one) / (1e-3 + other))
            code = code << 2 | int(audio.GRAY[np.searchsorted(audio.STEPS, value)])
        assert code == got[at]


def test_shards_are_even_and_stable(spark):
    names = [f"s{k}" for k in range(10)]
    size = sharding.next_prime(1000)
    table = sharding.fill(names, size)
    assert size == 1009 and set(np.bincount(table)) <= {100, 101}
    fewer = sharding.fill(names[:-1], size)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.35 * size
    df = spark.createDataFrame([(i,) for i in range(500)] + [(None,), (3,)], "doc_id long").withColumn("k", F.lit(0))
    got = sharding.place(df, "doc_id", names)
    assert got.count() == 502 and got.where("doc_id = 3").select("shard").distinct().count() == 1
    assert all(r["shard"] == names[table[r["slot"]]] for r in got.collect())
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sharding.place(df.limit(0), "doc_id", names).count() == 0
    clash = sharding.place(df.withColumnRenamed("k", "slot").withColumn("shard", F.lit("x")), "shard", ["a\nb", "c"])
    assert clash.columns == ["doc_id", "slot", "shard"] and set(r["shard"] for r in clash.collect()) <= {"a\nb", "c"}


def test_audit_locates_damage(spark):
    ours = [("f", i, f"record {i}") for i in range(300)] + [("g", i, f"other {i}") for i in range(40)] + [("f", 7, "twin"), ("h", 0, None)]
    theirs = [r for r in ours if r != ("f", 100, "record 100")]
    theirs = [("f", 200, "changed") if r == ("f", 200, "record 200") else r for r in theirs] + [("g", 77, "new")]
    schema = "file string, position long, record string"
    got = warc.audit(spark.createDataFrame(ours, schema).withColumn("node", F.lit("clash")), spark.createDataFrame(theirs[::-1], schema).withColumn("node", F.lit("clash")))
    found = sorted((r["file"], r["position"], r["status"]) for r in got.collect())
    # "changed" is shorter than the record it replaces and a record is lost: all that follows has other offsets
    assert [f for f in found if f[2] != "moved"] == [("f", 100, "missing"), ("f", 200, "corrupt"), ("g", 77, "extra")]
    assert [f[1] for f in found if f[2] == "moved"] == [p for p in range(101, 300) if p != 200]
    same = spark.createDataFrame(ours, schema)
    assert warc.audit(same, same).count() == 0
    assert warc.audit(same, same.limit(0)).count() == 341 and warc.audit(same.limit(0), same.limit(0)).count() == 0


def test_offsets_are_hashed(spark):
    """Two places of one file exchange bytes: no content is new, yet what lies between has other offsets."""
    schema = "file string, position long, record string"
    ours, theirs = [("f", 0, "ab"), ("f", 1, ""), ("f", 2, "c")], [("f", 0, "a"), ("f", 1, ""), ("f", 2, "bc")]
    got = {r["position"]: r["status"] for r in warc.audit(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema)).collect()}
    assert got == {0: "corrupt", 1: "moved", 2: "corrupt"}


def test_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "v", "b"), (1, "u", "é")], "page_id long, url string, html string")
    found = warc.page_records(pages).collect()
    assert sum(r["file"].startswith("pages-loose-") for r in found) == 2 and all(0 <= r["position"] < 1000 for r in found)
    assert warc.audit(warc.page_records(pages), warc.page_records(pages)).count() == 0


def test_query_table_size_matches_its_statement():
    assert sharding.next_prime(100 * len(queries.SHARDS)) == 6421


PROSE = ["north fields of oats and rye {} lie under snow", "{} farmers wait for the thaw and mend their tools", "until spring the mills of {} stand still"]


@pytest.mark.parametrize("frame,extra", [
    ('<div class=page><h1>Head {0}</h1><p class=lead>Lead {0}</p><div class=text>{1}</div></div>', ["Head {0}", "Lead {0}"]),
    ("<form id=aspnetForm><div class=menu><a href=/>Home</a></div><div><h1>Head {0}</h1>{1}</div></form>", ["Head {0}"]),
    ("<form id=aspnetForm><div>{1}</div></form>", []),
    ("<div class=comment>{1}</div>", []),
    ("<article><h1>Head {0}</h1>{1}<p class='social history'>Their social {0} past</p><p>End {0}</p></article>", ["Head {0}"]),
])
def test_articles_of_other_makes(spark, frame, extra):
    """Four pages a host, no word of the article lost and nothing of menus and footers kept."""
    pages, expected = [], {}
    for k in range(4):
        said = [p.format(f"land{k}") for p in PROSE]
        body = "".join(f"<p>{x}.</p>" for x in said)
        pages.append((k, f"http://make.example/{k}", f"<body><nav><a href=/>Home</a></nav>{frame.format(k, body)}<footer>Legal line</footer>"))
        expected[k] = [x.format(k) for x in extra] + [f"{x}." for x in said] + ([f"Their social {k} past", f"End {k}"] if "social" in frame else [])
    got = extract(spark, pages)
    assert {k: got[k][0].split("\n") for k in got} == expected


@pytest.mark.parametrize("constant", ["<blockquote>The same saying</blockquote>", "<p class=intro>The same saying</p>", "<figure><figcaption>The same saying</figcaption></figure>", "<table><tr><td>The same saying</td></tr></table>"])
def test_constant_text_within_an_article_stays(spark, constant):
    pages = [(k, f"http://same.example/{k}", f"<article><h1>Head {k}</h1>{constant}<p>{PROSE[0].format(k)}</p><div class=rights>All rights kept</div></article>") for k in range(4)]
    got = extract(spark, pages)
    assert {k: got[k][0].split("\n") for k in got} == {k: [f"Head {k}", "The same saying", PROSE[0].format(k)] for k in range(4)}


def test_weak_words_on_linked_or_constant_texts_leave(spark):
    pages = [(k, f"http://weak.example/{k}", f"<article><h1 class='entry header'>Head {k}</h1><p>{PROSE[0].format(k)}</p><p class=related><a href=/x>More on {k}</a></p><p class=search>Search here</p><h2 class='section header'>Part {k}</h2><p>{PROSE[1].format(k)}</p></article>") for k in range(4)]
    got = extract(spark, pages)
    assert {k: got[k][0].split("\n") for k in got} == {k: [f"Head {k}", PROSE[0].format(k), f"Part {k}", PROSE[1].format(k)] for k in range(4)}
