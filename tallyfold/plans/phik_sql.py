"""φK in SQL, by another method than the library's: the check of its numbers.

The probability of a cell of the bivariate normal is a power series in the correlation (Mehler's), whose
coefficients are integrals of Hermite polynomials over the cell's sides. Summed over cells, the expected
chi-square is a polynomial in the correlation, and bisection solves for it.
"""

from __future__ import annotations

#: Terms of the series; at a correlation of 0.95 what is left out is below 1e-6.
TERMS = 150


def phik_sql(tables: str, result: str) -> str:
    """The statement: ``tables`` define ``cells``, ``result`` reads ``solved`` (left_column, right_column, phik)."""
    return f"""
    WITH RECURSIVE {tables},
    lefts AS (SELECT left_column, right_column, left_value, SUM(n) AS r FROM cells GROUP BY 1, 2, 3),
    rights AS (SELECT left_column, right_column, right_value, SUM(n) AS c FROM cells GROUP BY 1, 2, 3),
    pairs AS (SELECT left_column, right_column, CAST(SUM(n) AS DOUBLE) AS n, COUNT(DISTINCT left_value) AS nx,
                     COUNT(DISTINCT right_value) AS ny,
                     SUM(n) * greatest(SUM(CAST(n AS DOUBLE) * n / (r * c)) - 1, 0) AS chi2
              FROM cells JOIN lefts USING (left_column, right_column, left_value)
              JOIN rights USING (left_column, right_column, right_value) GROUP BY 1, 2),
    sizes AS (SELECT DISTINCT s FROM (SELECT nx AS s FROM pairs UNION ALL SELECT ny FROM pairs) WHERE s > 1),
    edges AS (SELECT s, i, -5 + 10e0 * i / s AS x, exp(-pow(-5 + 10e0 * i / s, 2) / 2) / sqrt(2 * pi()) AS d
              FROM (SELECT s, unnest(range(s + 1)) AS i FROM sizes)),
    series AS (SELECT s, i, x, 0 AS k, x AS term, x AS total FROM edges
               UNION ALL SELECT s, i, x, k + 1, term * x * x / (2 * k + 3), total + term * x * x / (2 * k + 3)
               FROM series WHERE k < 90),
    below AS (SELECT e.s, e.i, e.x, e.d, 0.5 + e.d * total AS p FROM series JOIN edges e USING (s, i) WHERE k = 90),
    hermite AS (SELECT s, i, d, x, 0 AS k, 1e0 AS h, 0e0 AS before FROM edges
                UNION ALL SELECT s, i, d, x, k + 1, (x * h - sqrt(k) * before) / sqrt(k + 1), h
                FROM hermite WHERE k < {TERMS}),
    parts AS (SELECT a.s, a.i, a.k + 1 AS k, (a.h * a.d - b.h * b.d) / sqrt(a.k + 1) / sqrt(hi.p - lo.p) AS v
              FROM hermite a JOIN hermite b ON b.s = a.s AND b.i = a.i + 1 AND b.k = a.k
              JOIN below lo ON lo.s = a.s AND lo.i = a.i JOIN below hi ON hi.s = a.s AND hi.i = a.i + 1),
    grams AS (SELECT a.s, a.k, b.k AS l, SUM(a.v * b.v) AS g FROM parts a JOIN parts b ON a.s = b.s AND a.i = b.i GROUP BY 1, 2, 3),
    shapes AS (SELECT DISTINCT nx, ny FROM pairs WHERE least(nx, ny) > 1),
    powers AS (SELECT nx, ny, list(c ORDER BY m) AS c FROM (
                 SELECT nx, ny, a.k + a.l AS m, SUM(a.g * b.g) AS c FROM shapes JOIN grams a ON a.s = nx
                 JOIN grams b ON b.s = ny AND b.k = a.k AND b.l = a.l GROUP BY 1, 2, 3) GROUP BY 1, 2),
    whole AS (SELECT nx, ny, SUM(pow(greatest(least(xh.p, yh.p) - greatest(xl.p, yl.p), 0) - (xh.p - xl.p) * (yh.p - yl.p), 2)
                                 / ((xh.p - xl.p) * (yh.p - yl.p))) AS w
              FROM shapes JOIN below xl ON xl.s = nx JOIN below xh ON xh.s = nx AND xh.i = xl.i + 1
              JOIN below yl ON yl.s = ny JOIN below yh ON yh.s = ny AND yh.i = yl.i + 1 GROUP BY 1, 2),
    asked AS (SELECT left_column, right_column, chi2, n * (least(nx, ny) - 1) AS most, (nx - 1) * (ny - 1) AS noise, w, c
              FROM pairs JOIN powers USING (nx, ny) JOIN whole USING (nx, ny)),
    steps AS (SELECT left_column, right_column, chi2, most, noise, w, c, 0 AS k, 0e0 AS low, 0.5e0 AS mid, 1e0 AS high FROM asked
              WHERE chi2 > noise AND chi2 < most
              UNION ALL SELECT left_column, right_column, chi2, most, noise, w, c, k + 1, lo, (lo + hi) / 2, hi FROM (
                SELECT *, CASE WHEN under THEN mid ELSE low END AS lo, CASE WHEN under THEN high ELSE mid END AS hi FROM (
                  SELECT *, noise + (most - noise) / w * list_sum(list_transform(c, lambda v, i: v * pow(mid, i + 1))) < chi2 AS under
                  FROM steps WHERE k < 30))),
    solved AS (SELECT left_column, right_column, mid AS phik FROM steps WHERE k = 30
               UNION ALL SELECT left_column, right_column, CASE WHEN chi2 <= noise THEN 0e0 ELSE 1e0 END FROM asked
               WHERE chi2 <= noise OR chi2 >= most
               UNION ALL SELECT left_column, right_column, NULL FROM pairs WHERE least(nx, ny) < 2)
    {result}"""
