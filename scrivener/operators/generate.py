"""Generated texts for a table of prompts, checked and asked for again in rounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.operators.tables import written

#: A batch of systems, prompts, temperatures and top_p's to their texts.
Model = Callable[[pd.Series, pd.Series, pd.Series, pd.Series], pd.Series]
#: Codes that another attempt may mend; any other is final.
RETRYABLE = ("too_short", "repetition_detected")


def in_rounds(
    prompts: DataFrame, model: Model, check: Callable[[Column], Column] | None = None, retry: Column | str = "", retries: int = 2,
    settings: tuple[float, float] = (0.3, 0.92), retry_settings: tuple[float, float] = (0.35, 0.92), retryable: Sequence[str] = RETRYABLE,
) -> DataFrame:
    """The rows of ``prompts`` (system, user and any others) with text, code and attempts.

    ``check`` gives a text's first broken rule, or null.  A row whose code is in ``retryable`` goes on to the next round, with
    ``retry`` (which may depend on the row) after its prompt; all others are done, and after ``retries`` more rounds
    so is the rest, with its last text and code.  Null system and user are empty; a model's null is an empty text.

    A round is a job over the rows that are left.  Its texts are written before they are judged, so a model is asked once for
    each attempt, whatever is read later; only a task that is lost asks again for its own batch.
    """
    names = prompts.columns
    clash = {"text", "code", "attempts"} & set(names)
    if clash or not {"system", "user"} <= set(names):
        raise ValueError(f"prompts need system and user and may not have {sorted(clash)}")

    @F.pandas_udf(T.StringType())
    def ask(system: pd.Series, user: pd.Series, temperature: pd.Series, top_p: pd.Series) -> pd.Series:
        return pd.Series(model(system, user, temperature, top_p)).fillna("")

    ask = ask.asNondeterministic()
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    again = F.regexp_replace(F.lit(retry) if isinstance(retry, str) else retry, r"(?U)^\s+|\s+$", "")
    left, done = prompts, []
    for attempt in range(retries + 1):
        user = filled("user")
        if attempt:
            user = F.when(again != "", F.concat(user, F.lit("\n\n"), again, F.lit("\n"))).otherwise(user)
        temperature, top_p = retry_settings if attempt else settings
        said = written(left.select(*names, ask(filled("system"), user, F.lit(temperature), F.lit(top_p)).alias("text")))
        code = F.lit(None).cast("string") if check is None else check(F.col("text")).cast("string")
        judged = said.select(*names, "text", F.explode(F.array(code)).alias("code"), F.lit(attempt + 1).alias("attempts"))
        more = F.coalesce(F.col("code").isin(*retryable), F.lit(False)) if retryable and attempt < retries else F.lit(False)
        judged = written(judged.withColumn("more", more))
        done.append(judged.where("not more").drop("more"))
        left = judged.where("more").select(*names)
        if attempt < retries and left.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out
