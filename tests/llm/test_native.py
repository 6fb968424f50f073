"""Operators 1, 3, 6, 7 and 10 on small tables, against plain Python."""

import hashlib
import random
import re
import time
from itertools import combinations, product

import regex
from pyspark.sql import functions as F

from tests_llm_corpus import answers, awkward_rows, documents, prose
from gaugeframe.llm import chat_snapshots, line_chunks, quality_rules, templates, url_rules

# --- 1 ---------------------------------------------------------------------------------------


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in "n k a b h last each turns hash n_copies n_turns".split()})


def test_snapshots_collapse_to_the_longest(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (8, None, None, "x"), (8, 3, "user", "y")]
    rows += [(9, 0, "user", "hi"), (9, 1, "assistant", "hello"), (9, 2, "user", ""), (None, 0, "user", "hi")]
    out = {r["conv_id"]: r for r in chat_snapshots.collapse(turns(spark, rows)).collect()}
    assert {k: (r["n_turns"], r["n_copies"]) for k, r in out.items()} == {3: (4, 2), 6: (2, 1), 7: (2, 1), 8: (2, 1), 9: (3, 1)}
    assert out[6]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>"
    assert out[8]["text"].startswith("<|im_start|>\nx<|im_end|>")


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "use", "ra"), (2, 1, "user", "b"), (3, 0, "user", "a" * 200_000)]
    assert answers(chat_snapshots.collapse(turns(spark, rows)), "conv_id") == [(1,), (2,), (3,)]


def test_places_of_turns_count(spark):
    """Equal turns in another order, or once more, are other conversations."""
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "a"), (4, 0, "u", "a"), (4, 1, "u", "a"), (4, 2, "u", "a")]
    assert answers(chat_snapshots.collapse(turns(spark, rows)), "conv_id", "n_turns") == [(1, 2), (2, 2), (4, 3)]


def test_long_conversations_take_time_by_their_turns(spark):
    """A conversation of 100,000 turns and its snapshot one turn earlier."""
    n = 100_000
    talk = spark.range(2 * n - 1).select((F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"))
    talk = talk.withColumn("role", F.lit("user")).withColumn("text", F.concat(F.lit("t"), (F.col("turn") % 7).cast("string")))
    began = time.time()
    out = chat_snapshots.collapse(talk).select("conv_id", "n_turns", "n_copies", F.length("text").alias("size")).collect()
    assert [tuple(r) for r in out] == [(0, n, 1, n * len("<|im_start|>user\nt1<|im_end|>") + n - 1)] and time.time() - began < 60


def test_no_conversations(spark):
    assert chat_snapshots.collapse(turns(spark, [])).count() == 0


# --- 3 ---------------------------------------------------------------------------------------


def by_hand(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "http://net/",
    "https://x.net/a://b", "http://example.com/de/", "http://EXAMPLE.com/DE/", "http://notexample.com/de/1", "http://w.org/fr/", "http://w.org/fr",
    "http://ÄÖ.org?x=/fr/", "http://q.org#/fr/", "http://x.com/" + "p/" * 5000, "a://b://c/d",
]


def labelled(spark, n=400):
    """Urls of which those with both words are unwanted; ``win`` alone and ``casino`` alone are fine."""
    urls, bad = [], []
    for k in range(n):
        tokens = [("casino" if k % 3 == 0 else "news"), ("win" if k % 5 < 2 else "lose"), f"host{k % 7}"]
        urls.append((k, f"http://{tokens[2]}.example.com/{tokens[0]}/{tokens[1]}/{k}"))
        bad.append((k, 0 if "casino" in tokens and "win" in tokens and k % 30 else 1, 0))
    pages = spark.createDataFrame(urls + [(None, u) for u in URLS] + [(3, urls[3][1])], "page_id long, url string")
    marks = spark.createDataFrame(bad + [(None, 0, 0), (5, None, 0), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    return pages.withColumn("tokens", F.lit(1)).withColumn("confidence", F.lit(1)).withColumn("anchor", F.lit(0)), marks.withColumn("url", F.lit("x"))


def test_explicit_rules(spark):
    pages, labels = labelled(spark)
    out = url_rules.judge(pages, labels).where("page_id IS NULL")
    expected = sorted(((h, p, r, v or "allow") for h, p, r, v in map(by_hand, URLS)), key=str)
    assert answers(out, "host", "path", "rule", "verdict") == expected


def test_mined_rules_block_pairs_of_tokens(spark):
    pages, labels = labelled(spark)
    out = url_rules.judge(pages, labels).where("page_id IS NOT NULL").collect()
    assert len(out) == 401
    for row in out:
        both = "/casino/" in row["path"] and "/win/" in row["path"]
        assert row["verdict"] == ("block" if both else "allow"), row


def spelt(rules):
    """All rules of single tokens that the found ones stand for."""
    return {(tuple(sorted(t)), r["support"], r["confidence"]) for r in rules.collect() for t in product(*r["members"])}


def all_subsets(data, most=4):
    """Rules from counting every set of up to ``most`` tokens in (bad, tokens)."""
    held = {t: sum(t in s for _, s in data) for t in set().union(*(s for _, s in data))}
    useful = {t for t, n in held.items() if max(url_rules.MIN_SUPPORT * len(data), url_rules.MIN_ROWS) <= n < len(data)}
    sure = {}
    for size in range(1, most + 1):
        for items in map(frozenset, combinations(sorted(useful), size)):
            n, bad = sum(items <= s for _, s in data), sum(items <= s and b for b, s in data)
            if bad >= max(url_rules.MIN_SUPPORT * len(data), url_rules.MIN_ROWS) and bad >= url_rules.MIN_CONFIDENCE * n:
                sure[items] = (bad, bad / n)
    return {(tuple(sorted(i)), *v) for i, v in sure.items() if not any(j < i and sure[j][1] >= v[1] for j in sure)}


def tokens_by_hand(url):
    return frozenset(x for x in re.split(r"[^a-z0-9]+", url.split("://")[1]) if x and not x.isdigit())


def test_mined_rules_against_all_subsets(spark):
    pages, labels = labelled(spark)
    rows = pages.join(labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")), "page_id")
    expected = all_subsets([(r["bad"], tokens_by_hand(r["url"])) for r in rows.collect()])
    assert spelt(url_rules.mine(rows.select("url", "bad"))) == expected and expected


def template_urls(segments, n=240):
    """Urls of two sites with a template each; those of the first with ``win`` are unwanted, as are most with ``deal``."""
    first, second = ("/".join(f"{side}seg{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(segments)) for side in ("x", "y"))
    rows = []
    for k in range(n):
        site = first if k % 2 else second
        extra = ("win" if k % 3 == 0 else "news") + ("/deal" if k % 5 == 0 else "")
        rows.append((f"http://host{k % 2}.example/{site}/{extra}/{k}", (k % 2 == 1 and k % 3 == 0) or (k % 5 == 0 and k % 20 != 0)))
    return rows


def test_templates_against_all_subsets(spark):
    rows = template_urls(3)
    expected = all_subsets([(bad, tokens_by_hand(u)) for u, bad in rows])
    assert spelt(url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"))) == expected
    assert any(len(t) == 2 and any(x.startswith("xseg") for x in t) for t, *_ in expected)


def test_long_templates_are_one_item(spark):
    """30 fixed segments, which 2^30 sets of tokens hold; any one of them stands for the template."""
    rows = template_urls(30)
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    short = url_rules.mine(spark.createDataFrame(template_urls(1), "url string, bad boolean"))
    told = lambda rules: sorted((len(r["tokens"]), r["support"], r["confidence"]) for r in rules.collect())
    assert told(rules) == told(short) and max(len(m) for r in rules.collect() for m in r["members"]) == 31
    urls = ["http://other.example/xsegak/win", "http://other.example/ysegak/win", "http://other.example/xsegak/xsegbc"]
    found = url_rules.blocked(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert answers(found, "url") == [(urls[0],)]


def test_tokens_with_equal_row_hashes_are_checked(spark):
    """The hashes are made equal by force; rows that hold one token only tear the item."""
    rows = [(0, ["a", "b", "c"]), (1, ["a", "b"]), (2, ["c"]), (3, ["d", "e"]), (4, ["d", "e"])]
    held = spark.createDataFrame(rows, "row long, tokens array<string>").select("row", F.explode("tokens").alias("token"))
    useful = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.lit(0)).withColumn("y", (F.col("token") > "c").cast("int"))
    found = {r["token"]: (r["item"], r["members"]) for r in url_rules.condensed(held, useful).collect()}
    assert found == {"a": ("a", ["a"]), "b": ("b", ["b"]), "c": ("c", ["c"]), "d": ("d", ["d", "e"]), "e": ("d", ["d", "e"])}


def test_frequent_tokens_make_rules(spark):
    """{big, x} is sure while {x} is not; the host ``spam`` of most urls is sure by itself."""
    rows = [(f"http://{'big' if k % 10 < 6 else 'small'}.example/{'x' if k % 2 else 'y'}", k % 2 == 1 and k % 10 < 6) for k in range(200)]
    found = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert found == {("big", "x"): (60, 1.0)}
    rows = [(f"http://{'spam' if k % 5 else 'fine'}.example/{k}", k % 5 > 0) for k in range(200)]
    found = {tuple(r["tokens"]): (r["support"], r["confidence"]) for r in url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert found == {("spam",): (160, 1.0)}


def test_few_rows_make_no_rule(spark):
    """One to four unwanted rows are no rule on a small table; five are, as long as they are 0.005 of it."""
    for n, expected in ((3, set()), (98, {("five",)}), (1000, {("five",)})):
        words = ["one"] + ["four"] * 4 + ["five"] * 5 + [f"good{k % 3}" for k in range(n)]
        rows = [(f"http://host.example/{w}", not w.startswith("good")) for w in words[:n]]
        found = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
        assert {tuple(r["tokens"]) for r in found} == expected


def test_no_pages_and_no_labels(spark):
    pages, labels = labelled(spark)
    assert url_rules.judge(pages.limit(0), labels).count() == 0
    out = url_rules.judge(pages, labels.limit(0))
    assert out.count() == pages.count() and out.where("verdict = 'block' AND rule IS NULL").count() == 0


# --- 6 ---------------------------------------------------------------------------------------


def cleaned_by_hand(rows):
    """Per row the numbers of removed lines and runs, and the kept text, from comparing all pairs of neighbouring lines."""
    key = lambda t: hashlib.md5(t.encode()).hexdigest()[:15]
    first, solid = {}, {}
    place = lambda d, t, k: (d is not None, d or 0, key(t), k)
    for d, t, *_ in rows:
        if t is not None:
            solid[d, t] = [i for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
            lines = [t.split("\n")[i] for i in solid[d, t]]
            for k, two in enumerate(zip(lines, lines[1:])):
                first[two] = min(first.get(two, place(d, t, k)), place(d, t, k))
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, 0, 0, 0, None))
            continue
        every = t.split("\n")
        lines = [every[i] for i in solid[d, t]]
        gone = sorted({k + j for k, two in enumerate(zip(lines, lines[1:])) for j in (0, 1) if first[two] != place(d, t, k)})
        runs = sum(k - 1 not in gone for k in gone)
        drop = {solid[d, t][k] for k in gone}
        out.append((d, len(every), len(gone), runs, "\n".join(x for i, x in enumerate(every) if i not in drop)))
    return sorted(out, key=str)


REPORT = ["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text"]


def line_rows():
    """Texts of few different lines, with blank ones, so that chunks repeat in all ways."""
    rng = random.Random(8)
    words = ["A", "B", "C", "D", "E", "F", "", " ", "\t", "é", "a b"]
    made = [(100 + k % 50, "\n".join(rng.choice(words) for _ in range(rng.randint(1, 9))), "en", "a") for k in range(80)]
    return awkward_rows() + made + made[:5] + [(200, "x\n" * 20_000 + "y", "en", "a")]


def test_line_chunks_against_all_pairs_of_lines(spark):
    rows = line_rows()
    assert answers(line_chunks.line_report(documents(spark, rows)), *REPORT) == cleaned_by_hand(rows)
    assert line_chunks.line_report(documents(spark).limit(0)).count() == 0


def test_equal_hashes_are_told_apart_by_bytes(spark):
    rows = line_rows()[:60]
    weak = line_chunks.line_report(documents(spark, rows), key=lambda x: F.xxhash64(F.substring(x, 1, 1)))
    assert answers(weak, *REPORT) == cleaned_by_hand(rows)


def test_each_line_stays_where_it_comes_first(spark):
    rows = [r for r in line_rows() if r[1]]
    out = line_chunks.line_report(documents(spark, rows)).collect()
    lines = lambda texts: {x for t in texts for x in t.split("\n") if x.strip()}
    assert lines(r["text"] for r in out) == lines(r[1] for r in rows)


def test_every_two_lines_hold_a_boundary(spark):
    rows = [r for r in line_rows() if r[1]]
    docs = documents(spark, rows, clashes=False).withColumn("th", line_chunks.text_key(F.col("text")))
    at = {}
    for r in line_chunks.boundaries(docs).collect():
        at.setdefault((r["doc_id"], r["th"]), set()).add(r["at"])
    n = 0
    for row in docs.collect():
        solid = [x for x in row["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n += max(0, len(solid) - 1)
        assert all({k, k + 1} & at[row["doc_id"], row["th"]] for k in range(len(solid) - 1))
    assert n > 100


def test_line_stage_keeps_columns(spark):
    docs = documents(spark)
    out = line_chunks.keep_lines(docs)
    assert out.columns == docs.columns and out.where("doc_id = 2").count() == 0 and out.where("text IS NULL").count() == 2
    assert line_chunks.keep_lines(docs.limit(0)).count() == 0


def test_short_passages_go_from_the_middle(spark):
    """Passages of two to five lines inside different texts go whole, from all but the first text; blank lines stay."""
    line = lambda seed: " ".join(f"{seed}w{k}" for k in range(30))
    rows = []
    for n in range(2, 6):
        for seed in range(20):
            passage = [line(f"p{n}x{seed}y{k}") for k in range(n)]
            for d in range(2):
                own = [line(f"d{n}x{seed}y{d}z{k}") for k in range(6)]
                rows.append((1000 * n + 10 * seed + d, "\n".join([*own[:3], *passage, *own[3:5], "", "", own[5]]), "en", "a"))
    docs = documents(spark, rows)
    for out in (line_chunks.keep_lines(docs), line_chunks.line_report(docs)):
        texts = {r["doc_id"]: r["text"] for r in out.collect()}
        for key, text, *_ in rows:
            n = key // 1000
            lines = text.split("\n")
            assert texts[key] == (text if key % 10 == 0 else "\n".join(lines[:3] + lines[3 + n :])), key


# --- 7 ---------------------------------------------------------------------------------------

ITEM = "A train leaves Berlin at 9.30 and travels 240 km to Hamburg while Anna waits 3 hours for the train in Hamburg and reads."


def template(text):
    text = regex.sub(r"(?<=[\p{Ll}\p{N},;])[ \t\n\x0b\f\r]+(?=\p{Lu})", " \1", (text or "").replace("\1", " ").replace("\2", " "))
    text = regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", "\2", text)
    text = regex.sub("[^\\p{L}\\p{M}\\p{N}\1\2]+", " ", text)
    raw = regex.sub(r"(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})", " ", text).lower().split()
    shape = []
    for token in raw:
        kind = "<name>" if token[0] == "\1" else "<num>" if regex.fullmatch("\\p{Nd}[\\p{Nd}\2]*", token) else token
        shape.append("<unit>" if shape and shape[-1] == "<num>" and kind in templates.UNITS else kind)
    return raw, shape


def brute_hits(docs, items):
    known = []
    for item, text in items:
        for raw, shape in (template(text), tuple(x[1:] for x in template("a " + (text or "")))):
            size = min(len(raw), templates.WINDOW)
            for at in range(len(raw) - size + 1) if size >= templates.SHORTEST else ():
                cut = shape[at : at + size]
                if sum(not t.startswith("<") for t in cut) >= templates.LITERALS:
                    known.append((item, raw[at : at + size], cut))
    out = set()
    for doc, text in docs:
        raw, shape = template(text)
        for item, i_raw, cut in known:
            for at in range(len(shape) - len(cut) + 1):
                if shape[at : at + len(cut)] == cut:
                    pairs = {(t, a, b) for t, a, b in zip(cut, i_raw, raw[at : at + len(cut)]) if t.startswith("<")}
                    if len({(t, a) for t, a, _ in pairs}) == len(pairs):
                        out.add((doc, item))
    return out


def leak_rows():
    other = ITEM.replace("Berlin", "Paris").replace("Hamburg", "Lyon").replace("9.30", "7.15").replace("240", "410").replace("Anna", "Marie")
    broken = other.replace("waits 3 hours for the train in Lyon", "waits 3 hours for the train in Nice")
    return [
        (1, "Before. " + ITEM + " After.", "en", "a"),
        (2, prose(5, 40) + " " + other, "en", "a"),
        (3, prose(6, 300), "en", "a"),
        (4, broken, "en", "a"),
        (5, ITEM.replace("240 km", "240km").replace(" and ", " also "), "en", "a"),
        (6, None, "en", "a"),
        (7, "so he wrote: short items with eight words are found too here", "en", "a"),
        (None, ITEM, None, None),
        (8, ITEM, "en", "a"),
        (8, ITEM, "en", "a"),
        (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "en", "a"),
        (10, (prose(7, 20_000) + " ") + other, "en", "a"),
    ]


def benchmark(spark):
    items = [(1, ITEM), (2, None), (3, "too short"), (None, "short items with eight words are found too"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    return items, spark.createDataFrame(items, "item_id long, text string").withColumn("raw", F.lit(1)).withColumn("size", F.lit("x"))


def test_reparameterised_items_are_found(spark):
    items, bench = benchmark(spark)
    out = templates.leaks(documents(spark, leak_rows()), bench)
    found = {(r["doc_id"], r["item_id"]): r for r in out.collect()}
    assert set(found) == brute_hits([r[:2] for r in leak_rows()], items)
    assert {1, 2, 8, 10} <= {d for d, _ in found} and not {3, 9} & {d for d, _ in found} and (7, None) in found
    assert found[2, 1]["reparameterised"] and not found[8, 1]["reparameterised"]


def test_slots_may_become_equal(spark):
    """3 and 5 may both become 4, while one 3 may not become 4 and 6."""
    item = "a box holds 3 red balls and 5 blue balls, then 3 balls go"
    texts = [item.replace("3", "4").replace("5", "4"), "a box holds 4 red balls and 5 blue balls, then 6 balls go", item.replace("3", "9")]
    rows = [(k, f"so: {t}", "en", "a") for k, t in enumerate(texts)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = set(answers(templates.leaks(documents(spark, rows), bench), "doc_id", "item_id"))
    assert found == {(0, 1), (2, 1)} == brute_hits([r[:2] for r in rows], [(1, item)])


def test_names_after_line_breaks(spark):
    """A copy with hard line breaks, also before names, has the template of its original."""
    broken = [ITEM.replace(" ", gap) for gap in ("\n", "\r\n", "\n\n  ", "\t")]
    rows = [(k, "see below\n" + t, "en", "a") for k, t in enumerate(broken)]
    assert [template(t) for t in broken] == [template(ITEM)] * 4
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = {r["doc_id"]: (r["n_windows"], r["reparameterised"]) for r in templates.leaks(documents(spark, rows), bench).collect()}
    assert set(found) == {0, 1, 2, 3} and len(set(found.values())) == 1 and not found[0][1]


def test_items_of_all_sizes(spark):
    """Items of 7 to 15 tokens: sizes below the window are looked up beside it."""
    items = [(n, " ".join(f"{chr(97 + n)}word{chr(97 + k)}" for k in range(n))) for n in range(7, 16)]
    rows = [(n, f"before it {t} and after", "en", "a") for n, t in items]
    found = set(answers(templates.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id"))
    assert found == {(n, n) for n in range(8, 16)} == brute_hits([r[:2] for r in rows], items)


def test_slots_must_fit(spark):
    _, bench = benchmark(spark)
    broken = {r["doc_id"]: r["n_windows"] for r in templates.leaks(documents(spark, leak_rows()), bench).collect()}
    assert broken.get(4, 0) < broken[2]


def test_clean_stage(spark):
    _, bench = benchmark(spark)
    docs = documents(spark, leak_rows())
    out = templates.keep_clean(docs, bench)
    bad = {d for d, _ in brute_hits([r[:2] for r in leak_rows()], benchmark(spark)[0])}
    assert out.columns == docs.columns
    assert answers(out, "doc_id") == sorted(((r[0],) for r in leak_rows() if r[0] not in bad), key=str)
    assert templates.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert templates.leaks(docs.limit(0), bench).count() == 0
    assert templates.leaks(documents(spark), bench).count() == 0


# --- 10 --------------------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = awkward_rows() + [(20, "a b c a b c a\vb\x0cc\rd" * 30, "en", "a"), (21, "#$ x|y\n\nx\n x\nx\n", "en", "a"), (22, "a a a a", "en", "a")]
    out = quality_rules.quality_report(documents(spark, rows))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert answers(out, *columns) == sorted(((r[0], *counts(r[1])) for r in rows), key=str)
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_fences_follow_the_source(spark):
    clean = [(k, prose(k, 80), "en", "plain") for k in range(40)]
    odd = [(100 + k, prose(k, 80).replace(" ", "# "), "en", "marked") for k in range(40)]
    junk = [(200, prose(200, 80).replace(" ", "## "), "en", "plain"), (201, prose(201, 80), None, "new")]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(documents(spark, clean + odd + junk)).collect()}
    assert all(out[k] for k in range(40)) and all(out[100 + k] for k in range(40)) and not out[200] and out[201]


def with_symbols(seed, n, every):
    """Prose of n words with a symbol after each word whose number ``every`` says."""
    words = prose(seed, n).split(" ")
    return " ".join(w + "#" * every(k) for k, w in enumerate(words))


def test_fences_follow_the_spread(spark):
    """A source with a wide spread keeps what a narrow one rejects; a tail narrower or wider than the quartiles counts."""
    narrow = [(k, with_symbols(k, 100, lambda i: i % 10 == 0), "en", "narrow") for k in range(60)]
    wide = [(100 + k, with_symbols(k, 100, lambda i: i % 100 < k), "en", "wide") for k in range(60)]
    odd = [(200, with_symbols(200, 100, lambda i: i % 2), "en", "narrow"), (201, with_symbols(201, 100, lambda i: i % 2), "en", "wide")]
    rows = quality_rules.quality_report(documents(spark, narrow + wide + odd)).collect()
    out = {r["doc_id"]: r for r in rows}
    assert out[1]["max_symbols"] < 300 < 600 < out[100]["max_symbols"]
    assert all(r["kept"] for r in rows if r["doc_id"] != 200) and not out[200]["kept"]


def test_a_tail_of_junk_does_not_widen_its_source(spark):
    """Where 12 % of a source are junk its own tail is junk; the tail of the language holds."""
    clean = [(k, prose(k, 100), "en", f"s{k % 5}") for k in range(500)]
    junk = [(1000 + k, with_symbols(k, 100, lambda i: 1), "en", "s0") for k in range(14)]
    out = {r["doc_id"]: r for r in quality_rules.quality_report(documents(spark, clean + junk)).collect()}
    assert all(out[k]["kept"] for k in range(500)) and not any(out[1000 + k]["kept"] for k in range(14))


def test_fences_do_not_hang_on_constants(spark, small):
    """On the given rows most fences come from the middle, the tail or the sizes of their own group."""
    out = quality_rules.quality_report(spark.read.parquet(small.replace("0.001", "0.1") + "/documents.parquet"))
    found = out.select("max_symbols", "max_lines", "max_repeats", "max_length", "min_length").distinct().toPandas()
    assert len(found) > 60 and found.nunique().min() >= 3


def test_quality_stage(spark):
    docs = documents(spark)
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1, 2, 7}
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
