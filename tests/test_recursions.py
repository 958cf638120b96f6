"""What the reference does element by element, against the plans that do it at once: apexes, keyframes, nearest free neighbours, alignment."""

import math
import random
from collections import Counter

from snapsift.config import DEFAULT
from snapsift.operators import cascade, match, visual


def tree(rng, n):
    paths, children = ["1"], Counter()
    for _ in range(n - 1):
        up = rng.choice(paths[-8:])
        children[up] += 1
        paths.append(f"{up}.{children[up]}")
    return sorted(paths, key=lambda p: [int(x) for x in p.split(".")])


def apexes_one_by_one(changes):
    """changes: path -> {property: (before, after)}. Parents come before their children."""
    px = lambda v: float(v[:-2]) if v and v.endswith("px") else None
    apex_of, out = {}, {}
    for path in sorted(changes, key=lambda p: p.count(".")):
        up = path
        parent = None
        while "." in up and not parent:
            up = up.rpartition(".")[0]
            parent = up if up in changes else None
        apex = apex_of.get(parent, parent)
        taken = set()
        for name, (a, b) in changes[path].items():
            if apex and name in changes[apex]:
                c, d = changes[apex][name]
                if name in cascade.INHERITED_AT_APEX:
                    alike = (a, b) == (c, d)
                else:
                    alike = name in cascade.PROPAGATED and None not in (px(a), px(b), px(c), px(d)) and abs((px(b) - px(a)) - (px(d) - px(c))) <= 2
                taken |= {name} if alike else set()
        if taken and len(taken) == len(changes[path]):
            apex_of[path] = apex
        out |= {(path, name): (name in taken, apex if name in taken else None) for name in changes[path]}
    return out


def test_apexes_like_one_by_one(spark):
    rng = random.Random(4)
    diffs, paths, want = [], [], {}
    for pair in range(25):
        places = tree(rng, 40)
        changes = {}
        for k, path in enumerate(places):
            paths.append((pair, k, path))
            if rng.random() < 0.7:
                pick = {"color": [("red", "blue"), ("red", None)], "font-size": [("10px", "12px"), ("10px", "14px")], "width": [("10px", "20px"), ("30px", "41px"), ("auto", "5px"), ("10px", "25px")], "border": [("a", "b")]}
                names = rng.sample(list(pick), rng.choice([1, 1, 1, 2, 3]))
                changes[path] = {n: rng.choice(pick[n]) for n in names}
                diffs += [(pair, k, n, *v) for n, v in changes[path].items()]
        want |= {(pair, *key): v for key, v in apexes_one_by_one(changes).items()}
    got = cascade.apex_suppression(spark.createDataFrame(diffs, "pair_id long, b_ord long, property string, base_value string, compare_value string").repartition(4), spark.createDataFrame(paths, "pair_id long, b_ord long, hpid string"))
    assert {(r.pair_id, r.hpid, r.property): (r.suppressed, r.apex) for r in got.collect()} == want
    assert sum(s for s, _ in want.values()) > 50 and len({a.count(".") for _, a in want.values() if a}) > 2


def frames_one_by_one(elements, viewport):
    """elements: (ord, path, top, height)."""
    total = max(y + h for _, _, y, h in elements)
    clamp = lambda y: 0 if total <= viewport else math.floor(max(0, min(y, total - viewport)))
    groups = {}
    for e in elements:
        groups.setdefault(e[1].split(".")[0], []).append(e)
    out, frame = {}, 0
    for members in sorted(groups.values(), key=lambda g: min(y for _, _, y, _ in g)):
        top, low = min(y for _, _, y, _ in members), max(y + h for _, _, y, h in members)
        if low - top <= viewport:
            out |= {o: (frame, clamp((top + low) / 2 - viewport / 2)) for o, *_ in members}
            frame += 1
            continue
        queue = sorted(members, key=lambda e: e[2])
        while queue:
            scroll = clamp(queue[0][2] - visual.PAD)
            n = max(1, next((k for k, e in enumerate(queue) if e[2] >= scroll + viewport), len(queue)))
            out |= {o: (frame, scroll) for o, *_ in queue[:n]}
            queue, frame = queue[n:], frame + 1
    return out


def test_keyframes_like_one_by_one(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for pair in range(30):
        elements = [(k, f"{rng.randint(1, 4)}.{k}", rng.choice([rng.randint(0, 900), rng.randint(0, 9) * 100]), rng.choice([5, 20, 150])) for k in range(rng.randint(1, 60))]
        total = max(y + h for _, _, y, h in elements)
        rows += [(pair, *e, total) for e in elements]
        want |= {(pair, o): v for o, v in frames_one_by_one(elements, 120).items()}
    got = visual.keyframes(spark.createDataFrame(rows, "pair_id long, ord long, hpid string, document_y long, height long, document_height long").repartition(4), 120)
    assert {(r.pair_id, r.ord): (r.frame, r.scroll_y) for r in got.collect()} == want


def nearest_free_one_by_one(base, comp, cell, least):
    used, out = set(), {}
    for o, tag, x, y in sorted(base):
        near = []
        for c, other, cx, cy in comp:
            dx, dy, d = cx // cell - x // cell, cy // cell - y // cell, math.hypot(cx - x, cy - y)
            if tag == other and abs(dx) <= 1 and abs(dy) <= 1 and d < cell and c not in used:
                near.append((d, dx, dy, c))
        if near and max(0.1, 1 - min(near)[0] / cell) * match.POSITION >= least:
            used.add(min(near)[3])
            out[o] = min(near)[3]
    return out


def test_nearest_free_like_one_by_one(spark):
    rng = random.Random(2)
    sides, want = ([], []), {}
    for pair in range(20):
        spread = rng.choice([1, 40, 300])  # heaps in one spot, crowds, and room for all
        made = [[(k, rng.choice("ab"), rng.randrange(spread) * 10 // 10, rng.randrange(spread)) for k in range(rng.randint(0, 40))] for _ in (0, 1)]
        for side, elements in zip(sides, made, strict=True):
            side += [(pair, o, t, (x, y)) for o, t, x, y in elements] + [(pair, 900, "a", None), (pair, 901, "a", (None, 3))]
        want |= {(pair, b): c for b, c in nearest_free_one_by_one(*made, 50, 0.05).items()}
    base, comp = (spark.createDataFrame(s, "pair_id long, ord long, tag_name string, rect struct<x:long,y:long>").repartition(4) for s in sides)
    got = match.position_matches(base, comp, DEFAULT.merge(min_position=0.05))
    assert {(r.pair_id, r.b_ord): r.c_ord for r in got.collect()} == want
    assert match.position_matches(base.limit(0), comp).collect() == []


def test_match_places_what_no_key_finds(spark):
    schema = "pair_id long, ord long, hpid string, absolute_hpid string, tag_name string, element_id string, css_selector string, xpath string, text_content string, styles map<string,string>, attributes map<string,string>, rect struct<x:long,y:long>"
    row = lambda k, path, x: (1, k, path, path, "a", None, None, None, None, {}, {}, (x, 0))
    base, comp = spark.createDataFrame([row(1, "1", 0), row(2, "2", 400)], schema), spark.createDataFrame([row(1, "8", 10), row(2, "9", 900)], schema)
    on = DEFAULT.merge(min_position=0.1, alignment=False)
    found = match.match(base, comp, on)
    assert [(r.b_ord, r.c_ord, r.strategy) for r in found["matches"].collect()] == [(1, 1, "position")]
    assert [r.ord for r in found["removed"].collect()] == [2] and [r.ord for r in found["added"].collect()] == [2]
    assert match.match(base, comp, DEFAULT.merge(alignment=False))["matches"].count() == 0
