"""URL templates against a plain tree, and what labels make of them."""

import random
import re
from collections import defaultdict

from lekhani.llm import url_templates

PAGE = "page_id long, url string, host string, template string, n int"


def brute(pages, labels, many=8, spread=0.5, evidence=10, z=1.96, prior=10.0):
    """page_id -> (template, purity) by a recursive tree over all pages."""
    found, by_host = {}, defaultdict(list)
    for i, url in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        number = re.search(r"([0-9]+)[^0-9]*$", path)
        by_host[host].append((i, [s for s in path.split("/") if s], labels.get(int(number[1])) if number else None))
    known = [g for rows in by_host.values() for *_, g in rows if g is not None]
    share = (sum(known) + prior) / (len(known) + prior)
    good = lambda rows: sum(g for *_, g in rows if g is not None)
    labelled = lambda rows: sum(g is not None for *_, g in rows)

    def walk(rows, at, template, above):
        purity = (good(rows) + prior * above) / (labelled(rows) + prior)
        if len({tuple(p) for _, p, _ in rows}) == 1:
            p = rows[0][1]
            template += "/" + "/".join(p[at:]) if len(p) > at else ""
            found.update({i: (template, purity) for i, *_ in rows})
            return
        kids = defaultdict(list)
        for row in rows:
            if len(row[1]) <= at:
                found[row[0]] = (template, purity)
            else:
                kids[row[1][at]].append(row)
        below = [r for k in kids.values() for r in k]
        merged = defaultdict(list)
        for seg, k in kids.items():
            others = labelled(below) - labelled(k)
            name = seg
            if len(kids) >= many and len(kids) > spread * len(below):
                name = "*"
            elif labelled(k) >= evidence:
                tenth = min(9, 10 * good(k) // labelled(k))
                like = [r for o in kids.values() if o is not k and labelled(o) >= evidence and min(9, 10 * good(o) // labelled(o)) == tenth for r in o]
                if labelled(like) >= evidence:
                    both = good(like + k) / labelled(like + k)
                    off = abs(good(k) / labelled(k) - good(like) / labelled(like))
                    if off <= z * (both * (1 - both) * (1 / labelled(k) + 1 / labelled(like))) ** 0.5:
                        name = f"~{tenth}"
            merged[name] += k
        for name, k in merged.items():
            walk(k, at + 1, f"{template}/{name}", purity)

    for rows in by_host.values():
        walk(rows, 0, "", share)
    return found


def _pages():
    r = random.Random(4)
    urls = []
    for i in range(400):
        urls.append(f"http://shop.org/{r.choice(['mp3', 'mp4', 'txt'])}/a/b/c/d/e/{i}")
    for i in range(400, 600):
        urls.append(f"https://Mixed.org/{r.choice(['good', 'bad', 'rare' + str(i % 5)])}/x{i}.html?q=1")
    urls += ["http://one.org", "http://one.org/", "http://solo.org/a/b/c", None, "none", "http://shop.org/mp3/a//b/c/d/e/7", "http://shop.org/mp3"]
    rows = list(enumerate(urls))
    labels = {i: not (f"/{bad}/" in (u or "")) for i, u in rows for bad in [("mp3" if i < 400 else "bad")] if i < 600 and r.random() < 0.9}
    return rows, labels


def test_templates_and_purity_as_by_brute_force(spark):
    rows, labels = _pages()
    pages = spark.createDataFrame([(i, u, "clash", "clash", 1) for i, u in rows], PAGE)
    known = spark.createDataFrame([(i, g, "x") for i, g in labels.items()] + [(None, True, "x"), (5000, None, "x")], "label_id long, good boolean, host string")
    got = {r["page_id"]: r for r in url_templates.filter_urls(pages, known).collect()}
    want = brute(rows, labels)
    assert len(got) == len(rows)
    assert {i: (r["template"], round(r["purity"], 9)) for i, r in got.items()} == {i: (t, round(p, 9)) for i, (t, p) in want.items()}


def test_bad_branches_are_rejected_and_like_ones_merged(spark):
    rows, labels = _pages()
    got = url_templates.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "label_id long, good boolean")).collect()
    verdict = {r["page_id"]: (r["verdict"], r["template"]) for r in got}
    for i, u in rows[:600]:
        bad = "/mp3/" in u if i < 400 else "/bad/" in u
        assert verdict[i][0] == ("block" if bad else "allow"), (u, verdict[i])
    assert {verdict[i][1] for i in range(400) if "/mp3/" not in rows[i][1]} == {"/~9/a/b/c/d/e/*"}
    assert {verdict[i][1] for i in range(400) if "/mp3/" in rows[i][1]} == {"/mp3/a/b/c/d/e/*"}


def test_without_labels_and_rows_that_repeat(spark):
    rows, _ = _pages()
    pages = spark.createDataFrame(rows + rows[:50], "page_id long, url string")
    got = url_templates.filter_urls(pages, spark.createDataFrame([], "label_id long, good boolean")).collect()
    assert len(got) == len(rows) + 50
    assert {(r["verdict"], r["purity"]) for r in got} == {("allow", 1.0)}
