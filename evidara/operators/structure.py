"""Geometry of protein structures: exposed surface, contacts, exposure of half spheres, backbone angles, local superposition.

Neighbours are found in boxes. Space is cut into boxes of ``EDGE``; an atom is at home in one and a guest in each box that is within
reach of it, eight at most when the reach is under half an edge. Boxes are grouped apart, so a task holds the atoms around one box
and never a structure, however large it is; most structures fit into a few. Inside a box atoms are looked up in cells as wide as the
reach. Residues are joined to their neighbours along the chain by windows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.graph import _shared
from evidara.operators.skew import attach

EDGE = 96.0
#: Residues whose distances to all others around are taken at once.
STRIP = 128
# Radii of elements in angstroms, that of any other, the probe's, and the largest area of each residue (Tien et al.
# 2013, theoretical) with that of any other.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "SE": 1.9}
OTHER_RADIUS, PROBE = 1.8, 1.4
LARGEST = {
    "A": 129.0, "C": 167.0, "D": 193.0, "E": 223.0, "F": 240.0, "G": 104.0, "H": 224.0, "I": 197.0, "K": 236.0, "L": 201.0,
    "M": 224.0, "N": 195.0, "P": 159.0, "Q": 225.0, "R": 274.0, "S": 155.0, "T": 172.0, "V": 174.0, "W": 285.0, "Y": 263.0,
}
OTHER_AREA, MOST_EXPOSED = 200.0, 1.5
#: Ideal place of a missing CB, in terms of N to CA (b), CA to C (c) and b x c: published constants.
IDEAL_CB = (-0.54067466, 0.56802827, -0.58273431)
#: A CB farther than this from its CA belongs to no real residue; its contacts are counted in the boxes that its CA reaches.
SIDE = 2.0
#: Degrees of the backbone angles that count as helix: phi from, to, psi from, to; and as strand: phi from, to, psi beyond.
HELIX, STRAND = (-160.0, -20.0, -120.0, 50.0), (-180.0, -45.0, 90.0, -150.0)


def sphere(n: int) -> np.ndarray:
    """``n`` points spread evenly over the unit sphere: equal steps along an axis, each turned on by the golden angle."""
    i = np.arange(n)
    z = 1 - (2 * i + 1) / n
    turn = i * (math.pi * (3 - math.sqrt(5)))
    flat = np.sqrt(1 - z * z)
    return np.column_stack([flat * np.cos(turn), flat * np.sin(turn), z])


def boxed(points: DataFrame, reach: float, edge: float = EDGE) -> DataFrame:
    """``points`` (structure, x, y, z and more) with box and whether each is at home there, in every box within ``reach``. Boxes are
    numbered from the least coordinates of a structure; those beyond its largest are nobody's home and are left out."""
    axes = ("x", "y", "z")
    span = points.groupBy("structure").agg(*[f(c).alias(f"__{n}_{c}") for c in axes for f, n in ((F.min, "from"), (F.max, "to"))])
    out = attach(points, span, "structure")
    cell = lambda c, by: F.floor((F.col(c) - F.col(f"__from_{c}") + by) / edge)
    last = lambda c: F.floor((F.col(f"__to_{c}") - F.col(f"__from_{c}")) / edge)
    for c in axes:
        out = out.withColumn(f"box_{c}", F.explode(F.sequence(F.greatest(cell(c, -reach), F.lit(0)), F.least(cell(c, reach), last(c)))))
    home = (F.col("box_x") == cell("x", 0)) & (F.col("box_y") == cell("y", 0)) & (F.col("box_z") == cell("z", 0))
    return out.withColumn("home", home).drop(*[f"__{n}_{c}" for c in axes for n in ("from", "to")])


BOX = ["structure", "box_x", "box_y", "box_z"]


def neighbours(xyz: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``own`` and rows of ``xyz`` of all pairs that stand in the same cell or in adjoining ones, by place; cells are
    ``reach`` wide, so no pair within it is left out. A row pairs with itself."""
    cell = np.floor((xyz - xyz.min(axis=0)) / reach).astype(np.int64) + 1
    wide = cell.max(axis=0) + 2
    key = (cell[:, 0] * wide[1] + cell[:, 1]) * wide[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    lined, mine = key[order], key[own]
    at, to = [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            middle = mine + (dx * wide[1] + dy) * wide[2]
            first = np.searchsorted(lined, middle - 1, "left")
            n = np.searchsorted(lined, middle + 1, "right") - first
            at.append(np.repeat(np.arange(len(own)), n))
            to.append(order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
    at, to = np.concatenate(at), np.concatenate(to)
    by = np.argsort(at, kind="stable")
    return at[by], to[by]


def exposed(xyz: np.ndarray, radius: np.ndarray, home: np.ndarray, points: np.ndarray, strip: int = 4096) -> np.ndarray:
    """Area of each atom of ``home`` that no other atom's sphere covers; ``radius`` includes the probe."""
    at = np.nonzero(home)[0]
    hidden = np.zeros(len(at))
    for s in range(0, len(at), strip):
        own = at[s : s + strip]
        i, j = neighbours(xyz, own, 2 * radius.max())
        close = (((xyz[own[i]] - xyz[j]) ** 2).sum(axis=1) < (radius[own[i]] + radius[j]) ** 2) & (own[i] != j)
        i, j = i[close], j[close]
        starts = np.searchsorted(i, np.arange(len(own) + 1))
        # as many atoms at a time as have some thousands of neighbours
        for a, b in _runs(starts, 4096):
            mine, near = own[i[starts[a] : starts[b]]], j[starts[a] : starts[b]]
            surface = xyz[mine][:, None] + radius[mine][:, None, None] * points - xyz[near][:, None]
            covered = (surface**2).sum(axis=2) < radius[near][:, None] ** 2
            some = a + np.nonzero(np.diff(starts[a : b + 1]))[0]
            if len(some):
                hidden[s + some] = np.logical_or.reduceat(covered, starts[some] - starts[a], axis=0).mean(axis=1)
    return 4 * math.pi * radius[at] ** 2 * (1 - hidden)


def _runs(starts: np.ndarray, most: int):
    """Cuts a list of ranges, given by where they start, into runs of ``most`` items at most, or of one range."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield a, b
        a = b


def one_of_each(atoms: DataFrame) -> DataFrame:
    """The last of the atoms of one name in a residue, as it stands in the file; rows without coordinates are left out."""
    known = atoms.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    last = known.groupBy("structure", "position", "atom").agg(F.max_by(F.struct("residue", "x", "y", "z", "b_factor"), "line").alias("a"))
    return last.select("structure", "position", "atom", "a.*")


def surface_areas(atoms: DataFrame, n: int = 96) -> DataFrame:
    """area of each atom of ``one_of_each`` but hydrogens, by rolling a probe (``n`` points an atom)."""
    table = F.create_map(*[F.lit(v) for pair in RADII.items() for v in pair])
    element = F.when(F.startswith("atom", F.lit("SE")), "SE").otherwise(F.substring("atom", 1, 1))
    spheres = atoms.filter(element != "H").withColumn("radius", F.coalesce(F.element_at(table, element), F.lit(OTHER_RADIUS)) + PROBE)
    points = sphere(n)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf.home.to_numpy(bool)
        own = pdf.loc[home, ["structure", "position", "atom"]]
        return own.iloc[:0].assign(area=0.0) if own.empty else own.assign(area=exposed(pdf[["x", "y", "z"]].to_numpy(float), pdf.radius.to_numpy(float), home, points))

    reach = 2 * (max(*RADII.values(), OTHER_RADIUS) + PROBE)
    placed = boxed(spheres.select("structure", "position", "atom", "x", "y", "z", "radius"), reach)
    return placed.groupBy(BOX).applyInPandas(block, "structure string, position int, atom string, area double")


def dihedral(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Angles in degrees between the planes of a, b, c and of b, c, d (rows of points); not a number where a point is missing."""
    first, axis, last = b - a, c - b, d - c
    beyond = np.cross(axis, last)
    return np.degrees(np.arctan2(np.linalg.norm(axis, axis=1) * (first * beyond).sum(axis=1), (np.cross(first, axis) * beyond).sum(axis=1)))


def _points(pdf: pd.DataFrame, name: str) -> np.ndarray:
    return np.array([[np.nan] * 3 if v is None else v for v in pdf[name]], float).reshape(-1, 3)


POINTS = "structure string, position int, residue string, n array<double>, ca array<double>, c array<double>, cb array<double>, confidence double"


def residue_points(atoms: DataFrame) -> DataFrame:
    """``POINTS``: a row for each residue of ``one_of_each`` with its backbone atoms, its CB (an ideal one where it has none, else
    its CA) and its confidence."""
    point = lambda name: F.max(F.when(F.col("atom") == name, F.array("x", "y", "z"))).alias(name.lower())
    rows = atoms.groupBy("structure", "position").agg(F.max("residue").alias("residue"), *map(point, ("N", "CA", "C", "CB")), F.max(F.when(F.col("atom") == "CA", F.col("b_factor"))).alias("confidence"))

    def with_side(parts):
        for pdf in parts:
            n, ca, c, cb = (_points(pdf, name) for name in ("n", "ca", "c", "cb"))
            b, on = ca - n, c - ca
            ideal = IDEAL_CB[0] * on + IDEAL_CB[1] * b + IDEAL_CB[2] * np.cross(b, on) + ca
            cb = np.where(np.isnan(cb), np.where(np.isnan(ideal), ca, ideal), cb)
            yield pdf.assign(cb=[None if np.isnan(v).any() else v for v in cb])

    return rows.mapInPandas(with_side, POINTS)


def backbone(points: DataFrame) -> DataFrame:
    """phi, psi, helix, strand and curvature (the angle at the CA between those before and behind) of each residue."""
    order = Window.partitionBy("structure").orderBy("position")
    around = [F.lag("c").over(order).alias("c_before"), F.lead("n").over(order).alias("n_behind"), F.lag("ca").over(order).alias("ca_before"), F.lead("ca").over(order).alias("ca_behind")]

    def angles(parts):
        for pdf in parts:
            n, ca, c, c_before, n_behind, before, behind = (_points(pdf, name) for name in ("n", "ca", "c", "c_before", "n_behind", "ca_before", "ca_behind"))
            phi, psi = dihedral(c_before, n, ca, c), dihedral(n, ca, c, n_behind)
            u, v = before - ca, behind - ca
            with np.errstate(invalid="ignore", divide="ignore"):
                bend = np.degrees(np.arccos(np.clip((u * v).sum(axis=1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)), -1, 1)))
                helix = (phi >= HELIX[0]) & (phi <= HELIX[1]) & (psi >= HELIX[2]) & (psi <= HELIX[3])
                strand = (phi >= STRAND[0]) & (phi <= STRAND[1]) & ((psi >= STRAND[2]) | (psi <= STRAND[3]))
            yield pdf[["structure", "position"]].assign(phi=phi, psi=psi, helix=helix, strand=strand & ~np.isnan(phi), curvature=bend)

    made = points.select("structure", "position", "n", "ca", "c", *around).mapInPandas(angles, "structure string, position int, phi double, psi double, helix boolean, strand boolean, curvature double")
    return made.select("structure", "position", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("phi", "psi")], "helix", "strand", F.nanvl("curvature", F.lit(None).cast("double")).alias("curvature"))


def contacts(points: DataFrame, near: float = 8.0, far: float = 12.0, half: float = 13.0) -> DataFrame:
    """contacts_near and contacts_far (other residues' CB within those distances) and half_sphere_up (other CA within ``half`` on
    the side of the CB) of each residue with a CA."""
    flat = points.filter("ca is not null").select("structure", "position", *[F.get("ca", F.lit(i)).alias(c) for i, c in enumerate("xyz")], *[F.get("cb", F.lit(i)).alias(f"cb_{c}") for i, c in enumerate("xyz")])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        home = np.nonzero(pdf.home.to_numpy(bool))[0]
        ca, cb, out = pdf[["x", "y", "z"]].to_numpy(float), pdf[["cb_x", "cb_y", "cb_z"]].to_numpy(float), np.zeros((len(home), 3), int)
        square = lambda a, i: ((a - a[i][:, None]) ** 2).sum(axis=2)
        for s in range(0, len(home), STRIP):
            i = home[s : s + STRIP]
            apart, toward, away = square(cb, i), cb[i] - ca[i], ca - ca[i][:, None]
            around = square(ca, i) <= half**2
            around[np.arange(len(i)), i] = False
            ahead = away[:, :, 0] * toward[:, :1] + away[:, :, 1] * toward[:, 1:2] + away[:, :, 2] * toward[:, 2:] > 0
            up = np.where((toward**2).sum(axis=1) >= 1e-12, (ahead & around).sum(axis=1), 0)
            out[s : s + STRIP] = np.column_stack([(apart <= near**2).sum(axis=1) - 1, (apart <= far**2).sum(axis=1) - 1, up])
        made = pd.DataFrame(out, columns=["contacts_near", "contacts_far", "half_sphere_up"])
        return pdf.loc[home, ["structure", "position"]].reset_index(drop=True).join(made)

    # boxes are of CA: those of two CB within ``far`` are as far apart at most as that and each one's way from its CB
    out = "structure string, position int, contacts_near int, contacts_far int, half_sphere_up int"
    return boxed(flat, max(half, far + 2 * SIDE)).groupBy(BOX).applyInPandas(block, out)


def residue_features(atoms: DataFrame) -> DataFrame:
    """structure, position, residue, confidence, area, exposure (of the residue's largest area), contacts, half sphere and backbone
    of each residue of ``atoms`` (structure, line, atom, residue, position, x, y, z, b_factor)."""
    # written: atoms and residues are read by several steps, and would be read from their files and made again for each
    kept = _shared(one_of_each(atoms))
    points = _shared(residue_points(kept))
    area = surface_areas(kept).groupBy("structure", "position").agg(F.sum("area").alias("area"))
    largest = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in LARGEST.items() for v in pair]), F.col("residue")), F.lit(OTHER_AREA))
    key = ["structure", "position"]
    rows = points.select(*key, "residue", "confidence").join(area, key, "left").join(contacts(points), key, "left").join(backbone(points), key, "left")
    return rows.withColumn("exposure", F.least(F.lit(MOST_EXPOSED), F.col("area") / largest))


def mismatched(features: DataFrame, sequences: DataFrame) -> DataFrame:
    """structure and n_wrong of structures whose residues are not those of ``sequences`` (structure, sequence): models of another
    isoform, which are refused and never mapped."""
    held = features.join(sequences, "structure")
    fits = F.col("position").between(1, F.length("sequence")) & (F.substring(F.col("sequence"), F.col("position"), F.lit(1)) == F.coalesce("residue", F.lit("X")))
    return held.filter(~fits).groupBy("structure").agg(F.count("*").alias("n_wrong"))


def superposed_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square distance of two sets of points after the best rotation and shift."""
    p, q = a - a.mean(axis=0), b - b.mean(axis=0)
    u, _, vt = np.linalg.svd(p.T @ q)
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    return float(np.sqrt((((p @ u @ turn @ vt) - q) ** 2).sum(axis=1).mean()))
