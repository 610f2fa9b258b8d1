"""Signals in messages: tasks, questions, errors, identifiers, by keyword lists in four languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Words that signal a task, a question or an error. Fixed values.
TASK_VERBS = ["fix", "add", "update", "implement", "investigate", "debug", "verify", "refactor", "remove", "write", "create", "check", "review", "test", "plan", "analyze"]
TASK_KOREAN = [
    "해줘", "해주세요", "해 줘", "해 주세요", "부탁", "수정", "추가", "구현", "조사", "확인", "검토", "테스트", "삭제", "작성", "업데이트", "개선", "분석", "정리", "계획", "설계", "리팩터링", "디버그", "고쳐",
]
TASK_JAPANESE = ["してください", "して下さい", "お願いします", "修正", "追加", "実装", "調査", "確認", "検証", "削除", "更新", "改善", "作成", "分析"]
TASK_CHINESE = [
    "请", "請", "修复", "修復", "添加", "实现", "實現", "调查", "調查", "确认", "確認", "检查", "檢查", "测试", "測試", "删除", "刪除", "更新", "改进", "改進", "分析",
]
QUESTION_STARTS = ["what ", "why ", "how ", "when ", "where ", "which ", "who ", "can ", "could ", "would ", "will ", "should ", "is ", "are ", "do ", "does ", "did "]
QUESTION_CUES = [
    "can you", "could you", "would you", "will you", "please", "help", "가능", "할 수", "해줄", "해 줄", "어떻게", "왜", "무엇", "뭐", "언제", "어디", "나요", "까요", "습니까",
    "ですか", "ますか", "でしょうか", "かな", "できますか", "どう", "なぜ", "何", "いつ", "どこ", "吗", "嗎", "呢", "如何", "怎么", "怎麼", "为什么", "為什麼", "可以", "能否", "何时", "何時", "哪里", "哪裡", "请问", "請問",
]
ERROR_WORDS = [
    "error", "failed", "exception", "panic", "timeout", "오류", "실패", "예외", "에러", "エラー", "失敗", "例外", "タイムアウト", "错误", "錯誤", "失败", "异常", "異常", "超时",
]
USER_ROLES = ("user", "사용자", "유저", "ユーザー", "用户", "用戶")
TOOL_ROLES = ("assistant", "tool", "도구", "assistant/tool", "アシスタント", "ツール", "助手", "工具")
#: Replies by language: to a task, to an error with and without a name. Fixed values.
REPLIES = {
    "hangul": ("사용자 요청에 응답: ", "%s 오류를 처리하고 계속 진행: ", "최근 오류를 해결하고 계속 진행: "), "kana": ("ユーザー要求に対応: ", "%s エラーを解消して継続: ", "直近のエラーを解消して継続: "),
    "han": ("回应用户请求: ", "处理 %s 错误并继续: ", "处理最近错误并继续: "), "other": ("Respond to user request: ", "Address %s and continue: ", "Resolve the latest error and continue: "),
}
TASK_CHARS, REPLY_CHARS = 140, 180


def any_of(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def question_signal(text: Column) -> Column:
    """A question mark, and a question's beginning or one of its cues."""
    low = F.lower(text)
    starts = F.exists(F.array(*[F.lit(w) for w in QUESTION_STARTS]), lambda w: F.startswith(F.ltrim(low), w))
    return (F.contains(low, F.lit("?")) | F.contains(text, F.lit("？"))) & (starts | any_of(low, QUESTION_CUES))


def task_signal(text: Column) -> Column:
    """A question, an English task verb as a word, or a marker in the text's own script."""
    low, script = F.lower(text), T.language_profile(text)
    words = F.transform(T.split_white(low), lambda x: F.regexp_replace(x, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    english = F.startswith(low, F.lit("please ")) | F.arrays_overlap(words, F.array(*[F.lit(v) for v in TASK_VERBS]))
    own = F.when(script == "hangul", any_of(text, TASK_KOREAN)).when(script == "kana", any_of(text, TASK_JAPANESE)).when(script == "han", any_of(text, TASK_CHINESE)).otherwise(False)
    return question_signal(text) | english | own


def task_phrase(text: Column) -> Column:
    """The text, collapsed and cut, if it signals a task."""
    own = T.collapse(text)
    return F.when((own != "") & task_signal(own), F.substring(own, 1, TASK_CHARS))


def error_signal(text: Column) -> Column:
    return any_of(F.lower(text), ERROR_WORDS)


def error_identifier(text: Column) -> Column:
    """The name of an error: E and digits, else something with _, ::, / or :, else what begins with ERR."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_:/.-]+"), F.lit(0))
    first = lambda test: F.get(F.filter(found, test), F.lit(0))
    return F.coalesce(first(lambda t: t.rlike("^E[0-9]{2,}$")), first(lambda t: t.rlike("[_/:]")), first(lambda t: t.startswith("ERR")))


def reply(script: Column, task: Column, error: Column, identifier: Column) -> Column:
    """What to answer: to the task, or to the latest error first; null without a task."""
    out = F.lit(None).cast("string")
    for name, (plain, named, unnamed) in REPLIES.items():
        head, tail = named.split("%s")
        broken = F.when(identifier.isNotNull(), F.concat(F.lit(head), identifier, F.lit(tail))).otherwise(F.lit(unnamed))
        out = F.when(script == name, F.concat(F.when(error, broken).otherwise(F.lit(plain)), task)).otherwise(out)
    return F.substring(out, 1, REPLY_CHARS)


def list_items(text: Column) -> Column:
    """The bullet and numbered lines of a text."""
    own = F.filter(T.lines(text), lambda x: F.ltrim(x).rlike(r"^(?:[-*] |[0-9]+\. )"))
    return F.trim(F.array_join(own, "\n"))
