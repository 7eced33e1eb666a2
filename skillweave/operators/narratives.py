"""Sentences about phases, candidates and scores; the wordings are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<string>"


def _list(items: Column, n: int | None = None) -> Column:
    return F.array_join(F.slice(items, 1, n) if n else items, ", ")


def phase_narrative(phase: Column, title: Column, skills: Column, depth: Column) -> Column:
    """One paragraph on a phase by the mean depth of its skills."""
    head = F.concat(F.lit("Phase "), phase.cast("string"), F.lit(" - "), title, F.lit(": "))
    n, names = F.size(skills).cast("string"), _list(skills)
    return (
        F.when(depth < 1, F.concat(head, F.lit("Đây là những kiến thức nền tảng, bạn sẽ làm quen với "), n, F.lit(" kỹ năng cơ bản: "), names, F.lit(". Hoàn thành phase này giúp bạn có nền tảng vững chắc để tiếp cận các chủ đề nâng cao hơn.")))
        .when(depth < 2, F.concat(head, F.lit("Bạn sẽ xây dựng các kỹ năng cốt lõi bao gồm "), names, F.lit(". Đây là những kỹ năng quan trọng, xuất hiện thường xuyên trong các yêu cầu tuyển dụng.")))
        .when(depth < 3, F.concat(head, F.lit("Phát triển chuyên sâu với "), n, F.lit(" kỹ năng: "), names, F.lit(". Bạn sẽ áp dụng chúng vào các dự án thực tế.")))
        .otherwise(F.concat(head, F.lit("Đây là các kỹ năng nâng cao: "), names, F.lit(". Hoàn thành phase này giúp bạn sẵn sàng cho các vị trí senior hoặc chuyên sâu.")))
    )


def _some(items: list[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def personal_story(rows: DataFrame, key: str = "candidate") -> DataFrame:
    """(key, summary, focus, advice, strengths, top_missing) of rows (key, stage, role, completed, partial, missing, first_phase).

    The lists are arrays of skills in the order in which they count; null ones are empty.
    """
    get = lambda c: F.coalesce(F.col(c), F.array().cast(_NONE))
    owned, started, missing, first = (get(c) for c in ("completed", "partial", "missing", "first_phase"))
    strengths, top = F.slice(owned, 1, 5), F.slice(missing, 1, 3)
    stage = F.col("stage")
    who = F.when(stage == "Student", "bạn đang là sinh viên").when(stage == "Fresher", "bạn mới ra trường").when(stage == "Junior", "bạn đang ở cấp độ Junior").otherwise("bạn đã có kinh nghiệm")
    good = F.when(F.size(owned) > 0, F.concat(F.lit("Điểm mạnh hiện tại của bạn: "), _list(strengths), F.lit(". "))).otherwise("Bạn đang bắt đầu từ đầu. ")
    going = F.when(F.size(started) > 0, F.concat(F.lit("Bạn đang trong quá trình học "), _list(started, 3), F.lit(". "))).otherwise("")
    lack = F.concat(F.lit("Còn thiếu "), F.size(missing).cast("string"), F.lit(" kỹ năng quan trọng: "), _list(top), F.lit("."))
    summary = F.concat(F.lit("Chào bạn! "), who, F.lit(". Bạn đang nhắm đến vị trí "), F.col("role"), F.lit(". "), good, going, lack)
    focus = _some(
        [
            F.when(F.size(started) > 0, F.concat(F.lit("Hoàn thành "), _list(started, 2), F.lit(" trước"))),
            F.when(F.size(top) > 0, F.concat(F.lit("Tập trung vào "), F.try_element_at(top, F.lit(1)), F.lit(" - đây là kỹ năng cốt lõi"))),
            F.when(F.size(first) > 0, F.concat(F.lit("Bắt đầu với Phase 1: "), _list(first, 3))),
        ]
    )
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    advice = (
        F.when(stage == "Student", pair("Tận dụng thời gian ở trường để xây dựng portfolio", "Tham gia các câu lạc bộ hoặc dự án open source"))
        .when(stage == "Fresher", pair("Tập trung xây dựng các dự án cá nhân để chứng minh năng lực", "Chuẩn bị cho phỏng vấn với các câu hỏi về kỹ năng cốt lõi"))
        .otherwise(pair("Kết hợp học lý thuyết với thực hành qua dự án thực tế", "Cập nhật CV và LinkedIn sau mỗi phase"))
    )
    trend = F.when(F.arrays_overlap(top, F.array(F.lit("LLM"), F.lit("RAG"))), F.array(F.lit("Nên ưu tiên học LLM và RAG vì đây là xu hướng thị trường"))).otherwise(F.array().cast(_NONE))
    return rows.select(key, summary.alias("summary"), focus.alias("focus"), F.concat(advice, trend).alias("advice"), strengths.alias("strengths"), top.alias("top_missing"))


def score_report(rows: DataFrame, key: str = "candidate") -> DataFrame:
    """(key, report, weaknesses, next_actions, improvement) of rows (key, role, current_score, final_score, bottlenecks, penalties, phases).

    penalties is an array of (skill, penalty), phases one of (phase, delta) in order; of equal deltas the first phase counts.
    """
    now, last = F.col("current_score"), F.col("final_score")
    low = F.coalesce("bottlenecks", F.array().cast(_NONE))
    lost = F.coalesce("penalties", F.array().cast("array<struct<skill: string, penalty: double>>"))
    level = F.when(now < 30, "còn rất nhiều khoảng cách").when(now < 60, "đang ở mức trung bình").when(now < 80, "khá tốt").otherwise("rất tốt")
    total = F.aggregate(lost, F.lit(0.0), lambda a, x: a + x["penalty"])
    gained = last - now
    text = lambda c: c.cast("string")
    report = F.concat(
        F.lit("Bạn đạt "), text(now), F.lit("% mức độ phù hợp cho vị trí "), F.col("role"), F.lit(" - "), level, F.lit(". "),
        F.when(F.size(low) > 0, F.concat(F.lit("Điểm nghẽn chính: "), _list(low, 3), F.lit(". "))).otherwise(""),
        F.when(total > 0, F.concat(F.lit("Bạn bị trừ "), text(F.floor(total * 100)), F.lit("% do thiếu các kỹ năng nền tảng. "))).otherwise(""),
        F.when(gained > 0, F.concat(F.lit("Sau khi hoàn thành roadmap, bạn có thể đạt "), text(last), F.lit("% (tăng "), text(gained), F.lit("%)."))).otherwise(F.concat(F.lit("Hoàn thành roadmap giúp bạn đạt "), text(last), F.lit("%."))),
    )
    weak = F.slice(F.concat(low, F.array_distinct(F.filter(F.transform(lost, lambda x: x["skill"]), lambda s: ~F.array_contains(low, s)))), 1, 5)
    best = F.try_element_at(F.array_sort(F.transform("phases", lambda p: F.struct((-p["delta"]).alias("o"), p["phase"].alias("phase")))), F.lit(1))
    actions = _some(
        [
            F.when(F.size(low) > 0, F.concat(F.lit("Tập trung vào "), F.try_element_at(low, F.lit(1)), F.lit(" - đây là kỹ năng quan trọng nhất còn thiếu"))),
            F.when(best["o"] < 0, F.concat(F.lit("Hoàn thành Phase "), text(best["phase"]), F.lit(" để tăng "), text(-best["o"]), F.lit("% ATS"))),
        ]
    )
    actions = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("Bắt đầu với kỹ năng có độ khó thấp nhất trước")))
    return rows.select(key, report.alias("report"), weak.alias("weaknesses"), actions.alias("next_actions"), gained.alias("improvement"))
