import random

from regolith.operators.snapdiff import snapshot_changes

MANIFEST = "snapshot_id long, source_id string, section_no long, retrieved_at timestamp, record_count long, extra string"
ROWS = "snapshot_id long, row_no int, source_id string, record_id string, registration_number string, process_number string, document_url string, status string, expiry_date string, kind string"


def brute(manifest, rows):
    keyed, keyless = {}, {}
    for snap, no, src, rid, reg, proc, doc, status, exp, _ in rows:
        key = next((f"{src}:{t}:{v}" for t, v in (("id", rid), ("reg", reg), ("proc", proc), ("doc", doc)) if v), None)
        if key is None:
            keyless[snap] = keyless.get(snap, 0) + 1
        elif no >= keyed.setdefault(snap, {}).get(key, (-1,))[0]:
            keyed[snap][key] = (no, (status or "").strip().lower(), (exp or "")[:10])
    out, series = set(), {}
    for snap, src, sec, at, n, _ in sorted(manifest, key=lambda m: (m[3], m[0])):
        if len(keyed.get(snap, {})) + keyless.get(snap, 0) >= (n or 0):
            series.setdefault((src, sec), []).append(snap)
    for snaps in series.values():
        for b, a in zip(snaps, snaps[1:]):
            x, y = keyed.get(b, {}), keyed.get(a, {})
            for k in x.keys() | y.keys():
                if k not in x:
                    out.add((a, k, "appeared"))
                elif k not in y:
                    out.add((a, k, "disappeared"))
                else:
                    if x[k][1] != y[k][1]:
                        out.add((a, k, "status_changed"))
                    if x[k][2] and y[k][2] and x[k][2] != y[k][2]:
                        out.add((a, k, "expiry_changed"))
    return out


def test_against_brute_force(spark):
    from datetime import datetime, timedelta

    rng = random.Random(7)
    manifest, rows = [], []
    for sec in range(3):
        for v in range(4):
            snap = sec * 10 + (3, 1, 2, 0)[v]
            n = 0
            for no in range(40):
                if rng.random() < 0.2:
                    continue
                rid = rng.choice([str(no), str(no), "", None])
                rows.append((snap, no, "s", rid, rng.choice([f"R{no}", None]), None, rng.choice([None, "d"]), rng.choice(["Active", " active", "Gone", None, ""]), rng.choice([None, "2030-01-01T00", "2030-01-01", "2031-01-01"]), "clash"))
                n += 1
                if rng.random() < 0.1:
                    rows.append(rows[-1][:1] + (no + 100,) + rows[-1][2:])
            manifest.append((snap, "s", sec, datetime(2025, 1, 1) + timedelta(days=v), n + 5 if (sec, v) == (1, 2) else rng.choice([5, None]), "x"))
    m, r = spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(rows, ROWS)
    for depth in (1, 3):
        got = {(x.snapshot_id, x.record_key, x.kind) for x in snapshot_changes(m, r, depth).collect()}
        assert got == brute(manifest, rows)


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], MANIFEST), spark.createDataFrame([], ROWS)).count() == 0
