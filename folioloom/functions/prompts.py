"""Prompts as expressions: what a generator or judge is asked, with every part clipped to its budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(template: str, **parts: Column) -> Column:
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def answer(query: Column, context: Column) -> Column:
    return _filled("Answer from the sources only; say so if they don't hold the answer.\n\n[Sources]\n{context}\n\n[Question]\n{query}\n\n[Answer]", context=context, query=query)


def comparison(query: Column, first: Column, second: Column) -> Column:
    return _filled("Compare the two documents on the question.\n\n[A]\n{a}\n\n[B]\n{b}\n\n[Question]\n{query}", a=first, b=second, query=query)


def summary(query: Column, context: Column) -> Column:
    return _filled("Summarize by section: goal, method, result, conclusion.\n\n{context}\n\n[Request]\n{query}", context=context, query=query)


def quiz(query: Column, context: Column, cards: Column) -> Column:
    cards_form = "Write flash cards as a JSON list of front and back between [FLASHCARD_START] and [FLASHCARD_END].\n\n{context}\n\n[Request]\n{query}"
    quiz_form = "Write five questions with answers and explanations.\n\n{context}\n\n[Request]\n{query}"
    return F.when(cards == "flashcard", _filled(cards_form, context=context, query=query)).otherwise(_filled(quiz_form, context=context, query=query))


def hypothetical(query: Column, lang: Column) -> Column:
    korean = _filled("다음 질문에 답하는 논문의 한 단락을 쓰세요.\n\n{query}", query=query)
    return F.when(lang == "ko", korean).otherwise(_filled("Write one paragraph of a paper that answers the question.\n\n{query}", query=query))


def variants(query: Column, n: int) -> Column:
    return _filled("Ask the same in {n} other ways, a line each.\n\n{query}", n=F.lit(str(n)), query=query)


def translation(query: Column) -> Column:
    return _filled("Translate into English; answer with the translation only.\n\n{query}", query=query)


def follow_ups(query: Column, reply: Column, n: int) -> Column:
    clip = F.substring(reply, 1, 500)
    return _filled("Ask {n} further questions, a line each.\n\n[Before]\n{query}\n\n[Answer]\n{reply}", n=F.lit(str(n)), query=F.substring(query, 1, 200), reply=clip)


def compression(query: Column, text: Column) -> Column:
    return _filled("Keep only what answers the question, with its numbers and names.\n\n[Question]\n{query}\n\n[Text]\n{text}", query=query, text=F.substring(text, 1, 2000))


def section_summary(section: Column, text: Column) -> Column:
    return _filled("Summarize the section {section}.\n\n{text}", section=section, text=F.substring(text, 1, 3000))


def verdict(question: str, labels: tuple[str, ...], answer_: Column, context: Column) -> Column:
    """A judge's prompt: one label of the list."""
    head = f"{question} Answer with one of {', '.join(labels)}.\n\n[Answer]\n" + "{answer}\n\n[Context]\n{context}"
    return _filled(head, answer=F.substring(answer_, 1, 1000), context=F.substring(context, 1, 2000))
