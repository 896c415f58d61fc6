"""Golden scenario A (FIXTURES.md §3): seven sites, week 48 / 2025, expected values computed
independently from the formulas."""

import pytest

from weekcraft.plans import matrix as M

SITES = [
    # site, company, herd, weight, conc cost, g/l, conc, cons, greens, prod, cost, price, margin, fat, protein
    ("Fundo Los Robles", "ALPHA", 450, 420, 285.50, 320, 6.8, 4.2, 12.5, 32.5, 3850, 385, 8950, 3.95, 3.42),
    ("Hacienda El Vergel", "ALPHA", 380, 350, 290.00, 335, 7.2, 4.0, 11.8, 30.2, 3920, 378, 7650, 3.88, 3.35),
    ("Predio Santa Rosa", "ALPHA", 320, 295, 295.75, 345, 7.5, 3.8, 11.2, 28.8, 4050, 370, 6890, 3.80, 3.28),
    ("Estancia La Pradera", "BETA", 580, 540, 278.25, 310, 6.5, 4.5, 13.2, 34.8, 3780, 390, 9250, 4.02, 3.48),
    ("Fundo San Miguel", "BETA", 420, 385, 288.50, 330, 7.0, 4.1, 11.5, 29.5, 3950, 375, 7280, 3.85, 3.30),
    ("Hacienda Los Andes", "GAMMA", 680, 630, 270.00, 295, 6.2, 4.8, 14.0, 36.5, 3650, 398, 10250, 4.10, 3.55),
    ("Predio Valle Verde", "GAMMA", 490, 455, 282.00, 315, 6.6, 4.3, 12.8, 31.8, 3820, 382, 8150, 3.92, 3.38),
]
LABELS = ["Vacas masa", "Vacas en ordeña", "Costo promedio concentrado", "Grms concentrado / ltr leche",
          "Kg MS Concentrado / vaca", "Kg MS Conservado / vaca", "Praderas y otros verdes", "Producción promedio",
          "Costo ración vaca", "Precio de la leche", "MDAT", "Porcentaje de grasa", "Proteinas"]

EXPECTED = {  # site: rank, margin_l, cost_pct, total_ms
    "Hacienda Los Andes": (1, 27.329146, 0.251256, 25.0),
    "Estancia La Pradera": (2, 25.107692, 0.278515, 24.2),
    "Fundo Los Robles": (3, 22.500000, 0.307692, 23.5),
    "Predio Valle Verde": (4, 21.800000, 0.314465, 23.7),
    "Hacienda El Vergel": (5, 19.829630, 0.343390, 23.0),
    "Fundo San Miguel": (6, 18.966667, 0.357062, 22.6),
    "Predio Santa Rosa": (7, 17.854054, 0.380068, 22.5),
}
TOTAL = {"weight": 3075, "herd": 3320, "prod": 32.627480, "price": 385.343698, "cost": 3831.967480,
         "margin": 8595.967480, "margin_l": 22.307274, "cost_pct": 0.304782, "conc_cost": 282.404472,
         "grams_per_litre": 316.505365, "total_ms": 23.694309, "greens": 12.645041, "fat": 3.953707,
         "protein": 3.414829}


@pytest.fixture(scope="module")
def matrix(spark):
    rows = []
    for s in SITES:
        site, company, *vals = s
        for label, v in zip(LABELS, vals):
            rows.append((company, company, site, 48, label, float(v)))
    long = spark.createDataFrame(rows, "company string, company_code string, site string, week int, "
                                       "concept string, total double")
    hist = spark.createDataFrame([], "week int, site string, margin double, weight double")
    return {r["site"]: r.asDict() for r in M.build_matrix(long, hist).collect()}


def test_body(matrix):
    for site, (rank, ml, cp, tms) in EXPECTED.items():
        r = matrix[site]
        assert r["rank_margin"] == rank
        assert r["margin_l"] == pytest.approx(ml, abs=1e-6)
        assert r["cost_pct"] == pytest.approx(cp, abs=1e-6)
        assert r["total_ms"] == pytest.approx(tms, abs=1e-9)
        assert r["stocking"] is None and r["rank_4w"] is None and not r["is_total"]


def test_total_row(matrix):
    t = matrix[M.TOTAL_LABEL]
    assert t["is_total"]
    for k, v in TOTAL.items():
        assert t[k] == pytest.approx(v, abs=1e-6), k
    assert t["rank_margin"] is None and t["stocking"] is None
    assert t["weight_4w"] == 0.0


def test_selection_changes_ranks_and_totals(spark, matrix):
    """FLT-1: filtering sites before the matrix makes ranks relative to the selection."""
    rows = [(c, c, s, 48, lab, float(v)) for s, c, *vals in SITES if c == "ALPHA" for lab, v in zip(LABELS, vals)]
    long = spark.createDataFrame(rows, "company string, company_code string, site string, week int, "
                                       "concept string, total double")
    hist = spark.createDataFrame([], "week int, site string, margin double, weight double")
    m = {r["site"]: r for r in M.build_matrix(long, hist).collect()}
    assert m["Fundo Los Robles"]["rank_margin"] == 1
    assert m[M.TOTAL_LABEL]["weight"] == 420 + 350 + 295
