"""Games: cleaning a raw table and grouping by scores.

Raw columns: Name, Platform, Year of Release, Genre, NA sales, EU sales, JP sales, Other sales,
Critic Score, User Score, Rating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bin_half_open, narrow_to_short, parse_number
from ..operators.aggregates import categorical_crosscount, top_k, value_counts
from ..operators.quality import fill_group_mean, snake_case_columns

# Score bins and their labels, fillers, an obsolete rating and its successor.
SCORE_LABELS = ("низкая оценка", "средняя оценка", "высокая оценка")
USER_EDGES, CRITIC_EDGES = (0, 3, 8, 10), (0, 30, 80, 100)
NO_SCORE, NO_YEAR = -1.0, 0
OLD_RATING, NEW_RATING = "K-A", "E"


def clean_games(raw: DataFrame) -> DataFrame:
    """Names, types, gaps and duplicates put right.

    Regional sales are filled with the mean of the platform and year, missing scores with -1 and
    missing years with 0, in that order, so that unknown years fill nothing.
    """
    df = snake_case_columns(raw)
    numbers = ("na_sales", "eu_sales", "jp_sales", "other_sales", "critic_score", "user_score")
    df = df.withColumns({c: parse_number(F.col(c).cast("string")) for c in numbers})
    for c in ("eu_sales", "jp_sales"):
        df = fill_group_mean(df, c, ["platform", "year_of_release"])
    year = narrow_to_short(F.coalesce("year_of_release", F.lit(NO_YEAR)))
    df = df.withColumns({
        "year_of_release": year,
        "user_score": F.coalesce("user_score", F.lit(NO_SCORE)),
        "critic_score": F.coalesce("critic_score", F.lit(NO_SCORE)),
        "genre": F.lower("genre"),
    })
    return df.replace({OLD_RATING: NEW_RATING}, subset=["rating"]).dropDuplicates()


def with_score_categories(
    games: DataFrame, first_year: int = 2000, last_year: int = 2013, include_top: bool = False
) -> DataFrame:
    """Games of the period with a class for each score; the top score has none unless asked."""
    users = bin_half_open(F.col("user_score"), USER_EDGES, SCORE_LABELS, include_top)
    critics = bin_half_open(F.col("critic_score"), CRITIC_EDGES, SCORE_LABELS, include_top)
    return games.filter(F.col("year_of_release").between(first_year, last_year)).withColumns(
        {"categories_users": users, "categories_critics": critics}
    )


def score_crosscount(categorized: DataFrame) -> DataFrame:
    return categorical_crosscount(
        categorized, "categories_users", SCORE_LABELS, "categories_critics", SCORE_LABELS, "name"
    )


def top_platforms(games: DataFrame, k: int = 7) -> DataFrame:
    return top_k(value_counts(games, "platform").drop("share"), k, "n", ["platform"])
