import random
import re

from statewright.llm import licenses as L


def brute(rows, templates):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    spans = {n: k.span for k in L.classes(templates) for n in k.names}
    out = []
    for i, text in rows:
        own = shingles(words(text))
        for name, template in templates.items():
            wanted, found, at = set(shingles(words(template))), [], 0
            while at < len(own):
                inside = {x for x in own[at : at + spans[name]] if x in wanted}
                if own[at] in wanted and len(inside) >= 0.8 * len(wanted) - 1e-9:
                    last = max(k for k in range(at, min(len(own), at + spans[name])) if own[k] in wanted)
                    found.append((at, last + 5, len(inside) / len(wanted)))
                    at = last + 1
                else:
                    at += 1
            if found:
                out.append((i, name, len(found), max(f[2] for f in found), found[0][0], found[0][1]))
    return sorted(out)


def test_equals_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(tuple(r) for r in L.scan(documents).collect())
    assert got == brute(rows, L.TEMPLATES) and len({g[1] for g in got}) >= 4


def test_altered_templates(frame):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "short"), (4, "Released, under THE mit license"), (5, "x " * 50_000 + L.TEMPLATES["ISC"])]
    for k in range(400):
        name, text = rng.choice(sorted(L.TEMPLATES.items()))
        words = text.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{k}"
        fill = lambda: [f"w{rng.randrange(99)}" for _ in range(rng.randrange(120))]
        rows.append((100 + k, " ".join(fill() + words + fill() + (words if k % 5 == 0 else []))))
    clash = frame(rows).selectExpr("*", "1 AS license", "2 AS n_matches")
    assert sorted(tuple(r) for r in L.scan(clash).collect()) == brute(rows, L.TEMPLATES)
    assert L.scan(frame({})).count() == 0
    assert sorted(r.n_matches for r in L.scan(frame([(7, rows[3][1]), (7, rows[3][1]), (None, rows[3][1])])).collect()) == [1, 1]
