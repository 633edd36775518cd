"""URL filters: parsing, rules, and the template tree against brute force."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rinkspark.llm.url_filter import BINS, HOST_PRIOR, MERGE_Z, MIN_URLS, REJECT, TEMPLATE_PRIOR, judge_urls, rule_struct, url_host, url_path
from rinkspark.llm.url_queries import RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


URLS = [None, "", "no url", "http://", "HTTP://WWW.Example.ORG/es/1?x=/y#z", "https://example.org/en/12", "http://notexample.org/en/1", "http://a.com/fr/", "http://a.com/de/9", "http://com/de/", "x://Ä.com?/q", "x://h#f", "http://org", "http://a.b.org/"]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_parse_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i long, url string")
    df = df.select("i", url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p"))
    for r in df.select("*", rule_struct(F.col("h"), F.col("p"), RULES).alias("r")).collect():
        host, path = split(URLS[r.i])
        assert (r.h, r.p) == (host, path)
        assert (r.r["rule"], r.r["verdict"]) == rule(host, path) if r.r else rule(host, path) == (None, None)


def differs(h1, n1, h2, n2):
    if not (n1 and n2):
        return False
    p = (h1 + h2) / (n1 + n2)
    s = (p * (1 - p) * (1 / n1 + 1 / n2)) ** 0.5
    return s > 0 and abs(h1 / n1 - h2 / n2) > MERGE_Z * s


def brute(rows):
    """Verdicts of (id, host, segments, label or None) rows."""
    import re

    tmpl = {i: "" for i, *_ in rows}
    for d in range(max((len(s) for _, _, s, _ in rows), default=0)):
        children = defaultdict(list)
        for i, h, s, y in rows:
            if len(s) > d:
                children[h, tmpl[i], s[d]].append((y, len(s) > d + 1))
        siblings = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0, []]))
        for (h, t, seg), got in children.items():
            n, lab, bad, deep = len(got), sum(y is not None for y, _ in got), sum(y or 0 for y, _ in got), sum(x for _, x in got)
            if n >= MIN_URLS:
                own = siblings[h, t][BINS * bad // lab if lab else -1, BINS * deep // n]
                own[:4] = [own[0] + n, own[1] + lab, own[2] + bad, own[3] + deep]
                own[4].append(seg)
        branch = {}
        for key, bins in siblings.items():
            names, last = [], None
            for _, x in sorted(bins.items()):
                if last is None or (x[1] > 0) != (last[1] > 0) or differs(x[2], x[1], last[2], last[1]) or differs(x[3], x[0], last[3], last[0]):
                    names.append([])
                names[-1].extend(x[4])
                last = x
            for g in names:
                for seg in g:
                    branch[(*key, seg)] = seg if len(g) == 1 else f"{{{min(g)}|+{len(g) - 1}}}"
        new = {}
        for i, h, s, _ in rows:
            if len(s) > d:
                ext = re.search(r"(\.[A-Za-z]{1,5})$", s[d])
                new[i] = tmpl[i] + "/" + branch.get((h, tmpl[i], s[d]), "*" + (ext[1] if ext else ""))
        tmpl.update(new)
    tl, tb, hl, hb = Counter(), Counter(), Counter(), Counter()
    for i, h, _, y in rows:
        if y is not None:
            tl[h, tmpl[i]] += 1
            tb[h, tmpl[i]] += y
            hl[h] += 1
            hb[h] += y
    share = sum(hb.values()) / sum(hl.values()) if hl else 0
    out = {}
    for i, h, _, _ in rows:
        hs = (hb[h] + HOST_PRIOR * share) / (hl[h] + HOST_PRIOR)
        purity = (tb[h, tmpl[i]] + TEMPLATE_PRIOR * hs) / (tl[h, tmpl[i]] + TEMPLATE_PRIOR)
        out[i] = (tmpl[i], "block" if purity >= REJECT else "allow")
    return out


def test_templates_and_verdicts_equal_brute_force(spark):
    rows = []
    for k in range(400):
        host = ("a.com", "b.net", "c.org")[k % 7 % 3]
        seg = ("shop", "blog", "casino", "wiki")[k % 4]
        tail = f"/{k}.html" if k % 3 else f"/{k % 5}/x{k}"
        label = (1 if seg == "casino" else 0) if k % 5 else None
        rows.append((k, f"http://{host}/{seg}{tail}", label))
    rows += [(1000, None, None), (1001, "http://a.com", 1), (1002, "http://a.com", 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, label int, template string, host int")
    got = {r.page_id: (r.template, r.verdict) for r in judge_urls(df, [], bad_col="label").collect()}
    want = brute([(i, split(u)[0], [s for s in split(u)[1].split("/") if s], y) for i, u, y in rows])
    assert got == want
    assert {v for _, v in got.values()} == {"allow", "block"}


def test_rules_decide_first_and_label_the_rest(spark):
    rows = [(i, f"http://x.com/de/{i}") for i in range(30)] + [(100 + i, f"http://x.com/fr/{i}") for i in range(30)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert all(got[i].verdict == "block" and got[i].rule == "com/de/" for i in range(30))
    assert all(got[100 + i].verdict == "allow" and got[100 + i].rule == "com/fr/" for i in range(30))


def test_templates_without_labels_are_not_rejected(spark):
    rows = [(i, f"http://x.com/de/{i}") for i in range(60)] + [(100 + i, f"http://x.com/about/{i}") for i in range(30)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert got == {i: "block" if i < 100 else "allow" for i in got} and len(got) == 90


@pytest.mark.parametrize("sections", [20, 60, 1000])
def test_a_bad_branch_is_seen_on_a_host_of_any_size(spark, sections):
    rows = [(k, f"http://h.com/s0/{k}", 1 if k < 40 else None) for k in range(60)]
    rows += [(1000 + 40 * n + k, f"http://h.com/s{n}/{k}", 0 if k < 10 else None) for n in range(1, sections) for k in range(40)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, label int"), [], bad_col="label")
    assert {(r.bad, r.verdict) for r in got.select((F.col("page_id") < 1000).alias("bad"), "verdict").distinct().collect()} == {(True, "block"), (False, "allow")}


def test_many_siblings_and_deep_paths_equal_brute_force(spark):
    rows = []
    for k in range(900):  # 60 literal siblings of one parent, some bad, with different depths
        seg = k % 60
        rows.append((k, "h", [f"s{seg:02d}", *["x"] * (seg % 3), f"{k}.html"], (1 if seg < 7 else 0) if k % 2 else None))
    for k in range(40):  # twelve levels, told apart at the tenth
        rows.append((2000 + k, "h", [*"abcdefghi", "bad" if k % 2 else "good", "y", str(k)], k % 2))
    rows += [(3000, "h", ["z"] * 3000, None), (3001, "", [], None), (3002, "é", ["ä.PDF", "b"], 1)]
    df = spark.createDataFrame([(i, f"http://{h}/" + "/".join(s) if h else None, y) for i, h, s, y in rows], "page_id long, url string, label int")
    got = {r.page_id: (r.template, r.verdict) for r in judge_urls(df, [], bad_col="label").collect()}
    assert got == brute(rows)
    assert got[2001][1] == "block" and got[2000][1] == "allow" and len({t for t, _ in got.values() if t.startswith("/{s")}) >= 2


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
