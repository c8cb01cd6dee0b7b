import math

import numpy as np
import pytest

from evidara.operators import structure

ATOMS = "structure string, line int, atom string, residue string, position int, x double, y double, z double, b_factor double"


def chain(n, seed, size):
    rng = np.random.default_rng(seed)
    rows, line = [], 0
    for p in range(1, n + 1):
        for atom in ("N", "CA", "C", "O", *(["CB"] if p % 3 else []), *(["HA"] if p % 4 else [])):
            rows.append(["m", line, atom, "G" if p % 3 == 0 else "LAX"[p % 3], p, *(float(c) for c in rng.uniform(-size, size, 3)), 60.0 + p % 30])
            line += 1
    return rows


def brute_area(rows, points):
    held = [r for r in rows if not r[2].startswith("H")]
    xyz = np.array([r[5:8] for r in held])
    radius = np.array([{"C": 1.7, "N": 1.55, "O": 1.52}[r[2][0]] + 1.4 for r in held])
    out = {}
    for i, r in enumerate(held):
        surface = xyz[i] + radius[i] * points
        free = np.ones(len(points), bool)
        for j in range(len(held)):
            if j != i:
                free &= ((surface - xyz[j]) ** 2).sum(axis=1) >= radius[j] ** 2
        out[r[4]] = out.get(r[4], 0.0) + 4 * math.pi * radius[i] ** 2 * free.mean()
    return out


def test_features_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(structure, "EDGE", 24.0)
    rows = chain(70, 1, 20.0)
    got = {r.position: r for r in structure.residue_features(spark.createDataFrame(rows, ATOMS)).collect()}
    area = brute_area(rows, structure.sphere(96))
    at = {(r[4], r[2]): np.array(r[5:8]) for r in rows}
    cb = {}
    for p in range(1, 71):
        n, ca, c = at[p, "N"], at[p, "CA"], at[p, "C"]
        ideal = -0.58273431 * np.cross(ca - n, c - ca) + 0.56802827 * (ca - n) - 0.54067466 * (c - ca) + ca
        cb[p] = at.get((p, "CB"), ideal)
    for p in range(1, 71):
        r = got[p]
        assert r.area == pytest.approx(area[p], rel=1e-9) and r.confidence == 60.0 + p % 30
        assert r.exposure == pytest.approx(min(1.5, area[p] / structure.LARGEST.get(r.residue, 200.0)))
        ca = at[p, "CA"]
        up = sum((at[q, "CA"] - ca) @ (cb[p] - ca) > 0 for q in range(1, 71) if q != p and np.linalg.norm(at[q, "CA"] - ca) <= 13)
        assert r.half_sphere_up == up
        if 1 < p < 70:
            u, v = at[p - 1, "CA"] - ca, at[p + 1, "CA"] - ca
            assert r.curvature == pytest.approx(math.degrees(math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v))))
    assert got[1].phi is None and got[70].psi is None and got[1].curvature is None


def test_contacts_of_real_side_chains(spark):
    rng = np.random.default_rng(3)
    rows, line = [], 0
    ca = np.cumsum(rng.normal(size=(90, 3)) * 2.2, axis=0)
    for p in range(90):
        for atom, shift in (("CA", 0), ("CB", 1.53)):
            away = rng.normal(size=3)
            rows.append(["m", line, atom, "L", p + 1, *(float(c) for c in ca[p] + shift * away / np.linalg.norm(away)), 80.0])
            line += 1
    cb = np.array([r[5:8] for r in rows if r[2] == "CB"])
    apart = np.linalg.norm(cb[:, None] - cb[None], axis=2)
    got = {r.position: r for r in structure.residue_features(spark.createDataFrame(rows, ATOMS)).collect()}
    assert [(got[p + 1].contacts_near, got[p + 1].contacts_far) for p in range(90)] == [(int((apart[p] <= 8).sum()) - 1, int((apart[p] <= 12).sum()) - 1) for p in range(90)]


def test_surface_of_known_bodies(spark):
    one = [("a", 0, "CA", "A", 1, 0.0, 0.0, 0.0, 1.0), ("b", 0, "CA", "A", 1, 5.0, 5.0, 5.0, 1.0), ("b", 1, "CB", "A", 1, 6.5, 5.0, 5.0, 1.0), ("c", 0, "HA", "A", 1, 0.0, 0.0, 0.0, 1.0), ("d", 0, "CA", "A", 1, None, 0.0, 0.0, 1.0)]
    got = {(r.structure, r.atom): r.area for r in structure.surface_areas(structure.one_of_each(spark.createDataFrame(one, ATOMS)), 2000).collect()}
    whole = 4 * math.pi * 3.1**2
    assert got.keys() == {("a", "CA"), ("b", "CA"), ("b", "CB")} and got["a", "CA"] == pytest.approx(whole)
    # a cap of height r - d / 2 is covered by the other
    assert got["b", "CA"] == pytest.approx(whole * (1 - (3.1 - 0.75) / 6.2), rel=0.01)


def test_dihedral_signs():
    a, b, c = np.array([[1.0, 0, 0]]), np.array([[0.0, 0, 0]]), np.array([[0.0, 0, 1]])
    for angle in (-170, -60, 0, 45, 120):
        d = np.array([[math.cos(math.radians(angle)), math.sin(math.radians(angle)), 1.0]])
        assert structure.dihedral(a, b, c, d)[0] == pytest.approx(angle)


def test_models_of_other_isoforms_are_named(spark):
    features = spark.createDataFrame([("m", 1, "A"), ("m", 2, "C"), ("o", 1, "A"), ("o", 9, "C")], "structure string, position int, residue string")
    sequences = spark.createDataFrame([("m", "AC"), ("o", "AC")], "structure string, sequence string")
    assert [tuple(r) for r in structure.mismatched(features, sequences).collect()] == [("o", 1)]


def test_few_boxes_and_pairs_by_cells(spark):
    """A structure smaller than a box is one box, wherever it stands; cells leave out no pair within reach, in strips as well."""
    rows = chain(60, 3, 25.0)
    atoms = structure.one_of_each(spark.createDataFrame(rows, ATOMS))
    placed = structure.boxed(atoms, 6.6)
    assert placed.select(*structure.BOX).distinct().count() == 1 and placed.filter("home").count() == placed.count() == atoms.count()
    small = structure.boxed(atoms, 6.6, 20.0)
    assert small.filter("home").count() == atoms.count() and small.groupBy(*structure.BOX).agg({"home": "max"}).count() <= 27
    xyz = np.random.default_rng(5).uniform(-30, 30, (700, 3))
    own = np.arange(0, 700, 3)
    i, j = structure.neighbours(xyz, own, 6.6)
    near = ((xyz[own][:, None] - xyz) ** 2).sum(axis=2) < 6.6**2
    assert (np.diff(i) >= 0).all() and {(a, b) for a, b in zip(i.tolist(), j.tolist()) if near[a, b]} == set(map(tuple, np.argwhere(near).tolist()))
    radius = np.random.default_rng(6).uniform(1.5, 3.3, 700)
    home = np.arange(700) % 5 > 0
    whole = structure.exposed(xyz, radius, home, structure.sphere(40))
    assert np.array_equal(whole, structure.exposed(xyz, radius, home, structure.sphere(40), strip=37))
