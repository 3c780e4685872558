"""Vacancies: pay, places, grades, employers and skills.

Columns: id, name, employer, area, experience, schedule, employment, salary_from, salary_to,
key_skills_1..4, soft_skills_1..4.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_amount, excludes_all, number, round_half_up
from ..operators.aggregates import top_k

# Parts of names of the professions that are left out, and the skill columns.
OTHER_PROFESSIONS = (
    "родуктовый аналитик", "roduct Analyst", "roduct analyst", "roduct Data Analyst",
    "roduct data analyst", "roduct Data analyst", "изнес", "usiness", "BI", "нженер", "ngineer",
    "инансист", "кономист", "инансовый аналитик", "inance", "аркетолог", "1с", "1С",
    "еб-аналитик", "eb analyst",
)
SKILL_COLUMNS = (
    "key_skills_1", "key_skills_2", "key_skills_3", "key_skills_4",
    "soft_skills_1", "soft_skills_2", "soft_skills_3", "soft_skills_4",
)


def _mean(column: str, digits: int):
    """Mean of pay, rounded half up in decimal."""
    paid = exact_amount(F.sum(number(F.col(column)))).try_cast("decimal(28,6)")
    exact = F.try_divide(paid, F.count(column).cast("decimal(20,0)"))
    return F.round(exact, digits).cast("double")


def salary_span(vacancies: DataFrame) -> DataFrame:
    """Mean, least and largest lower and upper pay, in whole units, in one row."""
    out = []
    for c in ("salary_from", "salary_to"):
        out += [
            _mean(c, 0).alias(f"average_{c}"),
            round_half_up(F.min(number(F.col(c))), 0).alias(f"min_{c}"),
            round_half_up(F.max(number(F.col(c))), 0).alias(f"max_{c}"),
        ]
    return vacancies.agg(*out)


def vacancies_by(vacancies: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Vacancies per value, the missing value included; the ``k`` most frequent if asked."""
    counts = vacancies.groupBy(column).agg(F.count("id").alias("number_of_vacancies"))
    return counts if k is None else top_k(counts, k, "number_of_vacancies", [column])


def relevant(vacancies: DataFrame, patterns: Sequence[str] = OTHER_PROFESSIONS) -> DataFrame:
    """Vacancies whose name has none of the patterns; nameless ones drop out."""
    return vacancies.filter(excludes_all(F.col("name"), patterns))


def grades(vacancies: DataFrame, patterns: Sequence[str] = OTHER_PROFESSIONS) -> DataFrame:
    return vacancies_by(relevant(vacancies, patterns), "experience")


def employer_conditions(vacancies: DataFrame, k: int = 10) -> DataFrame:
    groups = vacancies.groupBy("employer", "schedule", "employment").agg(
        _mean("salary_from", 2).alias("avg_salary_from"),
        _mean("salary_to", 2).alias("avg_salary_to"),
        F.count("id").alias("number_of_vacancies"),
    )
    return top_k(groups, k, "number_of_vacancies", ["employer", "schedule", "employment"])


def skill_demand(
    vacancies: DataFrame, grade: str | None = None, columns: Sequence[str] = SKILL_COLUMNS
) -> DataFrame:
    """``(slot, skill, number_of_vacancies)`` of all skill columns from one pass, of one grade if
    asked. Each task counts its own rows first, so only one row per skill and task is shuffled."""
    rows = vacancies if grade is None else vacancies.filter(F.col("experience") == grade)
    return (
        rows.select("id", *columns).unpivot(["id"], list(columns), "slot", "skill")
        .groupBy("slot", "skill").agg(F.count("id").alias("number_of_vacancies"))
    )


def skill_totals(demand: DataFrame) -> DataFrame:
    """Demand summed over the slots of a kind (key or soft); blank skills are left out."""
    kind = F.substring_index("slot", "_", 1).alias("kind")
    named = demand.filter(F.trim("skill") != "")
    return named.groupBy(kind, "skill").agg(
        F.sum("number_of_vacancies").alias("number_of_vacancies")
    )
