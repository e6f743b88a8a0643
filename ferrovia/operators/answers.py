"""What questions about trains are told, whole: the texts of the trains found, what was not found, and the words around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .journeys import format_basic_info, format_train_info, trains_by_terminals

#: The words of answers.
NOTHING, MISSING, NO_TRAINS, HEADER = "未找到任何车次信息", "\n❌ 未找到以下车次信息: {}", "未找到从「{}」到「{}」的车次。", "从「{}」到「{}」的 {} 个车次:\n"
_TRAIN = ("train_code", "train_class", "from_station", "to_station", "stations")


def _said(words: str, *values: Column) -> Column:
    """words with values in the places of {}."""
    out = [F.lit(words.split("{}")[0])]
    for value, rest in zip(values, words.split("{}")[1:], strict=True):
        out += [value, F.lit(rest)]
    return F.concat(*out)


def _in_order(place: str, text: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text])


def _texts(codes: DataFrame, details: DataFrame, basic: DataFrame, shown: Column) -> DataFrame:
    """(train_code, text) of codes (train_code) that are known: with times from details, else as shown from basic."""
    timed = details.join(codes, "train_code", "left_semi").select("train_code", format_train_info(*[F.col(c) for c in _TRAIN], F.col("station_details")).alias("text"))
    bare = basic.join(codes, "train_code", "left_semi").join(details.select("train_code"), "train_code", "left_anti").select("train_code", shown.alias("text"))
    return timed.union(bare)


def train_info_answers(questions: DataFrame, details: DataFrame, basic: DataFrame) -> DataFrame:
    """questions (question, codes) to (question, text): the train of each code, in the order asked and as often, from details (train_code, train_class,
    from_station, to_station, stations, station_details) or else from basic (without times); then the codes that neither has. Case
    and blanks around a code don't count, null codes are passed over; a question without codes is told that there is nothing. Rows that repeat are answered
    as one question: question tells them apart. An empty table has no answers."""
    codes = questions.select("question", F.posexplode("codes").alias("at", "code")).where("code IS NOT NULL").select("question", "at", F.upper(F.trim("code")).alias("train_code"))
    none = F.lit(None).cast("array<struct<name:string,arrive:string,depart:string,no:int>>")
    texts = _texts(codes.select("train_code").distinct(), details, basic, format_train_info(*[F.col(c) for c in _TRAIN], none))
    told = codes.join(texts, "train_code", "left").groupBy("question").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"]).alias("parts"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.struct("at", "train_code")))), lambda x: x["train_code"]).alias("missing"),
    )
    missing = F.when(F.size("missing") > 0, F.array(_said(MISSING, F.array_join("missing", ", ")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat("parts", missing), "\n\n")
    return questions.select("question").distinct().join(told, "question", "left").select("question", F.coalesce(text, F.lit(NOTHING)).alias("text"))


def route_answers(requests: DataFrame, details: DataFrame, basic: DataFrame, limit: int = 3) -> DataFrame:
    """requests (from_station, to_station) to (from_station, to_station, text), one for each pair: the first `limit` trains of basic between
    these terminals by class and code, with times where details has the code; else that there is none. A request with a null station finds nothing
    and is left out."""
    asked = requests.select("from_station", "to_station").where("from_station IS NOT NULL AND to_station IS NOT NULL").distinct()
    found = trains_by_terminals(asked, basic, limit)
    texts = _texts(found.select("train_code").distinct(), details, basic, format_basic_info(*[F.col(c) for c in _TRAIN]))
    told = found.join(texts, "train_code").groupBy("from_station", "to_station").agg(_in_order("rank", "text").alias("parts"))
    ends = (F.col("from_station"), F.col("to_station"))
    text = F.concat(_said(HEADER, *ends, F.size("parts").cast("string")), F.array_join("parts", "\n\n"))
    return asked.join(told, ["from_station", "to_station"], "left").select("from_station", "to_station", F.coalesce(text, _said(NO_TRAINS, *ends)).alias("text"))
