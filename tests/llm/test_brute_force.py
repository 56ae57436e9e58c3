"""Operators beside plain Python on small tables: whole results, planted cases and odd rows in every stage."""

import math
import random
import re
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tactus.llm import common, embedding_dedup, html_extraction, packing, quality_rules, registry, rule_classifier, secret_scan
from tactus.llm.tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf=SF):
    return common.table(spark, sf, "documents").collect()


def words_of(text):
    return WORD.findall(text or "")


def similar_groups(texts):
    """doc -> (set size, least doc of its group) of {doc: text}, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            r, s = sets[a], sets[b]
            if r and s and 100 * min(len(r), len(s)) >= 80 * max(len(r), len(s)) and 100 * len(r & s) >= 80 * len(r | s):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    return {d: (len(sets[d]), group[d]) for d in sets}


def kept_by_rules(rows):
    """Positions of rows (text, lang, source) that the quality rules keep, by plain quantiles."""
    bins = lambda v: v if v < 32 else (((v >> (v.bit_length() - 5)) + 1) << (v.bit_length() - 5)) - 1
    stats = [dict(zip(quality_rules.COUNTS, quality_rules.text_stats((t or "").encode()), strict=True)) for t, _, _ in rows]
    sound = [s["n_words"] >= 20 and 100 * s["n_repeat_words"] <= 30 * s["n_words"] for s in stats]

    def limit(of, m):
        a, b, unit = quality_rules.METRICS[m]
        v = sorted(bins(unit * stats[i][a] // max(stats[i][b], 1)) for i in of)
        q50, q75 = (v[math.ceil(q * len(v) / 100) - 1] for q in (50, 75))
        return q75 + quality_rules.SPREAD * (q75 - q50)

    out = []
    for i, (_, lang, source) in enumerate(rows):
        if not sound[i]:
            continue
        groups = [[j for j, r in enumerate(rows) if sound[j] and r[1:] == (lang, source)], [j for j, r in enumerate(rows) if sound[j] and r[1] == lang], [j for j in range(len(rows)) if sound[j]]]
        of = next((g for g in groups[:2] if len(g) >= quality_rules.LEAST), groups[2])
        bad = False
        for m, (a, b, unit) in quality_rules.METRICS.items():
            most = limit(of, m) * max(stats[i][b], 1)
            excess = unit * stats[i][a] - most
            bad |= excess > 0 and excess**2 > quality_rules.SURE**2 * unit * max(most, unit)
        if not bad:
            out.append(i)
    return out


def water_filled(sizes):
    """source -> target: the level rises until 150 % of all words are shared, each source up to twice its own."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_jaccard_query_equals_all_pairs(spark):
    want = similar_groups({r.doc_id: r.text for r in documents(spark)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op6_jaccard_join"](spark, SF).collect()}
    assert got == want and len({g for _, g in want.values()}) < len(want)


def test_mixing_query_equals_water_filling(spark):
    rows = documents(spark)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words_of(r.text))
    got = registry.queries()["op8_mixing"](spark, SF).collect()
    again = registry.queries()["op8_mixing"](spark, SF).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    source, target, taken = {r.doc_id: r.source for r in rows}, water_filled(sizes), Counter()
    for r in got:
        assert r["size"] == r["size"] and 0 <= r.taken <= 2 * r["size"] and abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_pipeline_stages_equal_plain_python(spark):
    docs = common.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    kept = common.stored(stages["quality_rules"](spark, docs, SF), "test")
    assert Counter(kept.collect()) == Counter(rows[i] for i in kept_by_rules([(r.text, r.lang, r.source) for r in rows])) and 0 < kept.count() < len(rows)
    one = common.stored(stages["near_duplicates"](spark, kept, SF), "test")
    groups = similar_groups({r.doc_id: r.text for r in kept.collect()})
    assert {r.doc_id for r in one.collect()} == {g for _, g in groups.values()}
    masked = common.stored(stages["secret_scans"](spark, one, SF), "test")
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in masked.collect():
        if not any(map(secret_scan.randomness, secret_scan.LONG.findall(texts[r.doc_id]))):
            spans, want, at = plain_spans(texts[r.doc_id]), "", 0
            for a, _, b in spans:
                want += texts[r.doc_id][at:a] + "[secret]" if a >= at else ""
                at = max(at, b)
            assert r.text == want + texts[r.doc_id][at:] and r.n_chars == len(r.text)
    mixed = common.stored(stages["mixing"](spark, masked, SF), "test")
    sizes, taken = Counter(), Counter()
    for r in masked.collect():
        sizes[r.source] += len(words_of(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words_of(r.text))
    assert all(abs(taken[s] - t) <= 1 for s, t in water_filled(sizes).items())
    packed = stages["packing"](spark, mixed, SF).collect()
    ids = encoder(open(vocabulary_path("byte_bpe_50k.json")).read()).encode([(r.text or "").encode() for r in mixed.collect()])
    assert sum(r.length for r in packed) == sum(len(x) // 2 + 1 for x in ids)
    assert Counter(i for r in packed for i in np.frombuffer(r.ids, "<u2").tolist()) == Counter(i for x in ids for i in [*np.frombuffer(x, "<u2").tolist(), packing.END_ID])


ODD = "doc_id long, text string, lang string, source string, n_chars long, Kept string, n_words string, limits string, size string, taken string, row string, salt string, doc string, cut string, new string, c string, of_lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated doc_ids, null columns, empty texts, equal rows, and columns with names that the operators use themselves."""
    prose = lambda seed, n=60: " ".join(random.Random(seed).choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(random.Random(seed * 1000 + i).randint(0, 999)) for i in range(n))
    texts = [(1, prose(1)), (2, prose(2)), (None, prose(3)), (None, "too short"), (None, prose(3)), (1, prose(4)), (1, "short"), (5, None), (6, ""), (7, prose(2)), (7, prose(2)), (None, None)]
    return spark.createDataFrame([(d, t, [None, "en"][i % 2], [None, "b"][i % 2], len(t or ""), *["x"] * 12) for i, (d, t) in enumerate(texts)], ODD)


def test_stages_with_odd_rows(spark, odd):
    empty, out = odd.where("false"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, odd, "").collect()
        assert stage(spark, empty, "").count() == 0, name
        if name != "packing":
            assert out[name][0].__fields__ == odd.schema.names and all(r.Kept == "x" for r in out[name]), name
    rows = odd.collect()
    kept = [(r.doc_id, r.text) for r in out["quality_rules"]]
    assert Counter(kept) == Counter((r.doc_id, r.text) for r in rows if len(words_of(r.text)) >= 20)
    one = Counter((r.doc_id, r.text) for r in out["near_duplicates"])
    assert one == Counter((r.doc_id, r.text) for r in rows if r.doc_id != 7)
    mixed = out["mixing"]
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += len(words_of(r.text))
    for r in mixed:
        taken[r.source] += len(words_of(r.text))
    assert all(abs(taken[s] - t) <= 1 for s, t in water_filled(sizes).items()) and {r.doc_id for r in mixed} >= {None, 1, 2}
    packed = out["packing"]
    assert sum(r.start == 0 for r in packed) == len(rows) and sum(r.length for r in packed if r.doc_id is None and r.doc_tokens == 1) == 1


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in rule_classifier.query(spark, sf).collect() if r.held_out and r.doc_id in quality]
    right = sum(r.predicted == quality[r.doc_id] for r in rows) / len(rows)
    most = max(Counter(quality[r.doc_id] for r in rows).values()) / len(rows)
    assert right >= 0.97 and right > most


def test_embeddings_in_many_cells(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 6)), 8, axis=0) + 0.25 * rng.normal(size=(480, 6))
    x = np.concatenate([x, x[:7]])
    frame = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(frame, per_cell=20).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    centroids = embedding_dedup.spherical_kmeans(u, 24)
    home, who, _ = embedding_dedup.cells_of(u, centroids, embedding_dedup.distances(centroids))
    assert len(set(home.tolist())) > 10 and len(who) > 0
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
        if new == label:
            break
        label = new
    assert link.sum() > 500 and [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(link[i].sum()), label[i]) for i in range(len(x))]
    assert embedding_dedup.embedding_links(frame.where("false")).count() == 0


def plain_spans(text):
    """The base patterns' finds, a character at a time."""
    out, word = [], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        found = None
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if found or text[at : at + len(name)].lower() != name or not text[at : at + len(name)].isascii():
                continue
            for quote in (1, 0):
                i = at + len(name)
                if quote and text[i : i + 1] not in ("'", '"'):
                    continue
                i = run(i + quote, " ")
                if text[i : i + 1] not in (":", "=") or found:
                    continue
                i = run(i + 1, " ")
                i += text[i : i + 1] in ("'", '"') and i < len(text)
                end = run(i, word)
                if end > i:
                    found = (at, end, end - i)
        if found:
            if found[2] >= 6:
                out.append((found[0], 0, found[1]))
            at = found[1]
        else:
            at += 1
    for kind, head, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), allowed) if text.startswith(head, at) else at
            if end - at >= least:
                out.append((at, kind, end))
            at = end if end > at and (kind == 2 or end - at > len(head)) else at + 1
    return sorted(out)


def test_base_spans_equal_plain_search():
    r = random.Random(9)
    parts = ["password", "passwd", "Secret", "TOKEN", "apikey", "api_key", ":", "=", " ", "  ", '"', "'", "abc", "hunter22", "AKIA", "ABCDEFGH12345678", "X", "0a1b2c3d" * 3, "deadbeef", "é", "\n", "-", ".", "/", "secret=", "ſecret"]
    for _ in range(4_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert secret_scan.base_spans(t, t.encode()) == plain_spans(t), t


def test_planted_keys_are_found_and_identifiers_left(spark):
    r = random.Random(10)
    b62 = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGITS
    prose = [(x.doc_id, x.text) for x in documents(spark) if x.text]
    keys = {}
    for i in range(400):
        a = r.choice([b62, b62 + "+/", b62 + "-_", secret_scan.UPPER + "234567", secret_scan.LOWER + secret_scan.DIGITS, "0123456789ABCDEF"])
        keys[10_000 + i] = (r.choice(["auth=", "", "https://h/v1/", "KEY: "]), "".join(r.choice(a) for _ in range(r.choice([20, 24, 32, 40, 64, 128, 256, 512]))), r.choice(["", " and more words", "&n=1"]))
    names = ["user", "profile", "image", "Manager", "Factory", "get", "Element", "By", "Class", "android", "services", "release", "2024", "v2", "final", "Proxy"]
    plain = {20_000 + i: r.choice(["_", "-", "/", ""]).join(r.choice(names) for _ in range(r.randint(5, 9))) for i in range(400)}
    rows = prose + [(d, "".join(k)) for d, k in keys.items()] + list(plain.items())
    got = {x.doc_id: [(a, b) for a, k, b in x.spans if k == 3] for x in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    covered = sum(any(a <= len(h) + 2 and b >= len(h) + len(k) - 2 for a, b in got[d]) for d, (h, k, _) in keys.items())
    false = sum(bool(got[d]) for d in plain)
    assert covered >= 0.9 * len(keys) and false <= secret_scan.RATE * len(plain), (covered, false)


def host_texts(spark, pages, host="http://t"):
    rows = [(i, f"{host}/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_menus_without_names_go_by_their_slots(spark):
    r = random.Random(11)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    page = lambda i: f"<div><ul>{''.join(f'<li><a href=x>{name()}</a></li>' for _ in range(5))}</ul></div><article><h1>Title {i}</h1><p>Say {i}.</p><p>See <a href=y>this</a> too, {i}</p><div class='related-work'>Earlier work {i}</div><section><a href=z>{name()} {name()}</a></section></article><div>all rights kept</div>"
    assert host_texts(spark, [page(i) for i in range(8)]) == [f"Title {i}\nSay {i}.\nSee this too, {i}\nEarlier work {i}" for i in range(8)]
    bare = lambda i: f"<div><ul>{''.join(f'<li><a href=x>{name()}</a></li>' for _ in range(5))}</ul></div><div><h1>Title {i}</h1></div><div><p>Say {i}.</p></div>"
    assert host_texts(spark, [bare(i) for i in range(8)]) == [f"Title {i}\nSay {i}." for i in range(8)]


def test_html_tags_as_browsers_cut_them(spark):
    pages = ["<p title=it's>hello world</p><p>I don't know</p><p>end</p>", "<article>text<article class='comment'>reply</article></article>", "a <b>b<!-- x --!> c</b> <!--> d", "<p>x<a href='>'>y</a></p></3 z>w", "&lt;p&gt; a&nbsp;&nbsp;b", "<article><div class='ad'>buy</div><p>one</p><!-- <p>no</p> --></article>", "<p>open <a href='x", "one<br>two<hr>three"]
    assert [host_texts(spark, [p], f"http://h{i}")[0] for i, p in enumerate(pages)] == ["hello world\nI don't know\nend", "text", "a b c d", "xy\nw", "<p> a b", "one", "open", "one\ntwo\nthree"]


def test_centroid_distances_are_not_below_the_truth():
    c = embedding_dedup.unit(np.random.default_rng(3).normal(size=(3_000, 24)))
    c[7] = c[2_900]
    exact = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    got = embedding_dedup.distances(c)
    assert (got >= exact).all() and (got - exact).max() < 2e-6


def test_html_roles_by_names_and_forms(spark):
    """Frames of pages, names of paragraphs, threads and notices inside articles: by each host one page, so without templates."""
    body = "<p>The council met on Monday and agreed to mend the bridge.</p><p>Work begins in spring.</p>"
    text = "The council met on Monday and agreed to mend the bridge.\nWork begins in spring."
    pages = {
        f"<form id='aspnetForm'><input type=hidden><div>{body}</div></form>": text,
        f"<form><article><h1>T</h1>{body}</article><label>Search</label><input><button>Go</button></form>": "T\n" + text,
        f"<div>{body}</div><form><p>Sign up for our letter</p><label>Mail</label><input><button>Go</button></form>": text,
        "<form><p>Your name</p><input><p>Your mail</p><input><button>Send</button></form>": "",
        "<article><p class='share price'>Share price rose</p><h2 class='related'>Related</h2><p>x</p></article>": "Share price rose\nRelated\nx",
        f"<div class='menu'><article>{body}</article></div>": text,
        f"<div class='comments-off'><p>hi</p></div><article>{body}</article>": text,
        f"<article>{body}<section class='comments-area'><p>reader 4 says something</p></section></article>": text,
        f"<article>{body}<ol class='commentlist'><li>first</li></ol></article>": text,
        f"<article>{body}<div id='user-comments'><article><p>me too</p></article></div></article>": text,
        f"<article>{body}<ul><li class='comment'>first</li></ul></article>": text,
        f"<article><div class='notice'>We use your data</div>{body}<div class='cookie-notice'>ok?</div></article>": text,
        f"<article><div class='advert-slot'>Buy</div>{body}<aside>More</aside><div id='ad-banner'>Buy</div></article>": text,
        f"<div class='post has-comments no-sidebar'>{body}</div>": text,
        f"<div class='legal-footer'>{body}</div>": "",  # a name that only suggests a role, outside of an article
        f"<article><div class='related-work'>{body}</div></article>": text,
        f"<div class='modal'><main>{body}</main></div>": text,
        f"<div class='comments'><article>{body}</article></div><p>x</p>": "x",
        f"<form>{body}<form><p>nested</p></form>": text + "\nnested",
    }
    rows = [(i, f"http://r{i}/1", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {p: got[i] for i, p in enumerate(pages)} == pages


def test_templates_take_out_what_has_no_name(spark):
    """Boilerplate without a telling tag or name, in and outside of the article, goes by the template alone: roles change none of these pages."""
    page = lambda i: f"<div><div>Daily Post</div><div>All the news</div></div><article><h1>Title {i}</h1><p>Read us on paper, too.</p><p>Story {i} is told here.</p><p>Write to the desk.</p></article><div>Printed in town</div>"
    assert host_texts(spark, [page(i) for i in range(6)]) == [f"Title {i}\nStory {i} is told here." for i in range(6)]
    alone = host_texts(spark, [page(0)], "http://alone")  # a host of one page has no template
    assert alone == ["Title 0\nRead us on paper, too.\nStory 0 is told here.\nWrite to the desk."]


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<b>x<br>", "<p a='", "<!--", "&am", "= ", "<ul><li>x", "</p>", "<"])
def test_long_pages_take_linear_time(unit):
    took = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        html_extraction.tokens_of("<div>" + unit * (size // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1
