"""Broken prompt and response pairs.

Method: prompt and response tokens are aligned by shingle containment and longest
common subsequence, which flags copies; sentences, as sequences of kinds of words, are
aligned the same way against refusal templates. Three kinds of defect need another
method: empty answers are told by what is left without marks and placeholders, the
language of the prose by :mod:`marram.llm.languages`, and endings as in
:mod:`marram.llm.endings`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm import endings as E
from marram.llm.arrow import stage
from marram.llm.languages import Languages
from marram.llm.words import WORD
from marram.storage import write_through

# fixed values: what words say about answering, by stems, in English, German, French, Spanish, Russian and Chinese
LEXICON = {
    # the one who answers, and the one who asks
    "I": r"(?:i|i'm|i've|i'd|i'll|we|we're|me|my|us|our|ich|wir|mir|mich|uns|je|j|nous|me|yo|nos|я|мы|мне|нас)\b|我",
    "U": r"(?:you|your|sie|ihnen|ihre|vous|votre|usted|le|su|вы|вам|вас|ваш\w*)\b|您|你",
    # what is denied, missing or impossible
    "N": r"(?:not|no|none|nothing|nor|cannot|can't|cant|won't|don't|doesn't|didn't|isn't|aren't|wasn't|weren't|couldn't|wouldn't|shouldn't|haven't|hasn't|never|unable|without|hardly|neither|impossible|unsafe|unwise|inappropriate|wrong"
         r"|nicht|kein\w*|ohne|ne|n|pas|aucun\w*|impossible|sans|sin|ningun\w*|imposible|не|нет|без|невозможно)\b|无法|不能|不可|没有|没|不",
    "E": r"(?:enough|insufficient\w*|suffic\w*|lack\w*|missing|silent|contradict\w*|conflict\w*|incomplete|inconclusive|unavailable|unclear|ausreich\w*|reich\w*|genüg\w*|unzureichend\w*|fehl\w*|suffi\w*|insuffi\w*|manqu\w*|bast\w*|suficient\w*|insuficient\w*|falt\w*|недостаточн\w*|достаточн\w*|хвата\w*)\b|足够|不足",
    # the act of answering
    "A": r"(?:answer\w*|respond\w*|repl(?:y|ies)|help|assist\w*|comment\w*|tell|say|speculat\w*|guess\w*|advise|discuss\w*|talk\w*|address|statements?|explain|elaborate|clarify|weigh|opine|confirm|verify|determine"
         r"|beantwort\w*|antworten|helf\w*|auskunft\w*|hilf\w*|äußern|sagen|répond\w*|aider|renseign\w*|dire|parler|contest\w*|responder\w*|ayud\w*|decir|hablar|orientar|ответ\w*|помо\w*|сказать|говорить|подсказ\w*)\b|回答|答复|帮助|协助|解答",
    # what an answer would rest on
    "S": r"(?:informations?|info|context|details?|data|knowledge|access|excerpts?|passages?|sources?|documents?|documentation|pages|material\w*|evidence|chunks?|snippets?|retriev\w*|provided|given|instructions?|guidelines?|polic(?:y|ies)|manual"
         r"|angaben|auszüg\w*|kontext|quellen?|unterlagen|abschnitt\w*|kenntnis\w*|informationen|informations?|extraits?|contexte|données|sources|información|informaciones|datos|fragmentos?|contexto|fuentes?|detalles|информаци\w*|данны\w*|отрыв\w*|источник\w*|контекст\w*|сведени\w*)\b|信息|资料|内容|上下文",
    "D": r"(?:declin\w*|refus\w*|abstain\w*|refrain\w*|pass|turned|turn|reject\w*|withhold|avoid|prevent\w*|prohibit\w*|forbid\w*|rules?|verweiger\w*|ablehn\w*|lehne|refuser|décliner|rechazar|declinar|negarme|отказ\w*|воздерж\w*)\b|拒绝",
    "B": r"(?:outside|beyond|außerhalb|hors|fuera|вне|пределами)\b|超出",
    "O": r"(?:scope|remit|competence|expertise|area|abilit\w*|capabilit\w*|zuständig\w*|bereich\w*|compétence\w*|domaine|alcance|ámbito|competencia\w*|компетенци\w*|рам(?:ок|ки|ками))\b|范围|能力",
    "K": r"(?:know|knows|sure|certain|idea|aware|familiar|comfortable|allowed|permitted|able|possible|position|made|weiß|möglich|sicher|sais|possible|sé|seguro|posible|знаю|уверен\w*|возможно|могу)\b|知道|清楚",
    # being sorry, and sending the reader elsewhere
    "P": r"(?:sorry|apolog\w*|unfortunately|regret\w*|afraid|pardon|leider|tut|leid|entschuldig\w*|bedau\w*|désolé\w*|malheureusement|regrette|siento|lament\w*|disculp\w*|perdón|сожалени\w*|извин\w*|прост\w*)\b|抱歉|对不起|遗憾",
    "R": r"(?:please|consult|ask|asking|contact|rephras\w*|try|check|refer|feel|free|maintainers?|human|colleague|someone|question|request|topic|subject|matter|bitte|wend\w*|frag\w*|s'il|veuillez|demand\w*|question|favor|pregunt\w*|consulte|пожалуйста|обрат\w*|спрос\w*|вопрос\w*|запрос\w*)\b|请|问题",
}
# fixed values: refusals as sequences of these kinds; a sentence refuses when it holds one in order
REFUSALS = ("INA", "NIA", "NKA", "NAK", "KNA", "KA", "NES", "SNE", "SE", "ES", "NSA", "INS", "ID", "RD", "INK", "BO", "BIO", "SNS", "SNA", "ASN", "NA", "NR", "SER", "DA", "NKI", "SD", "NANA", "PRR", "RNA", "KIN")
# fixed values: refusals that hold only beside a word for the one who answers, an apology or a request
_NEEDS_PERSON = frozenset(("NA", "KA", "NR", "SE", "ES", "NKA", "ID", "SER", "NSA", "DA", "RD", "SNS", "SD"))
# fixed values: of these, those that a short sentence may say of its sources alone
_SHORT = frozenset(("SE", "ES", "SER", "NKA"))
SHORT_WORDS = 12
_KINDS = re.compile("|".join(f"(?P<{k}>(?<!\\w){v})" for k, v in LEXICON.items()))
_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
# fixed values: words that open a condition
_IF = re.compile(r"\W*(?:if|when|unless|wenn|falls|si|quand|lorsque|cuando|если|когда)(?!\w)|如果")
# fixed values: words that turn from a reservation to an answer
_TURN = re.compile(r"(?<!\w)(?:but|however|still|nevertheless|nonetheless|though|although|aber|jedoch|trotzdem|mais|cependant|toutefois|pero|sin embargo|aunque|но|однако|但|不过)(?!\w)|但是")
# fixed values: words that introduce a question rather than add to it
INTRODUCTIONS = frozenset("so the question is was you asked ask would like to know let me repeat q a answer your again in other words that want wanted vous avez demandé sie haben gefragt usted preguntó вы спросили вопрос frage question pregunta".split())
# fixed values: strings that stand for nothing
PLACEHOLDERS = frozenset("n a|na|tbd|todo|null|none|nil|nan|undefined|answer|response|br|empty|no answer|placeholder|lorem ipsum|xxx".split("|"))
# what is no prose (code, quotations, names, short list items), or a word of prose
_PROSE = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|(?m:^>[^\n]*$)"
    r"|(?m:^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S+(?:[ \t]+\S+){0,3}[ \t]*$)|[\w$]++(?:(?:::|->|[./\\])[\w$()]+)+|\$\w+|\w*_\w*|([^\W\d_]+(?:['’][^\W\d_]+)*)",
    re.S,
)
_SOME_WORDS = re.compile(r"(?:[^\W_]++[\W_]++){3}[^\W_]")
_SENTENCES = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
_NAMES = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_HAN = re.compile("[぀-鿿]")


def prose(text: str) -> list[str]:
    """Words of the prose of a text."""
    return [w for w in _PROSE.findall(text) if w]


#: Log-likelihood by which an answer must speak for its own language, and a question for its own, and words an answer needs.
EVIDENCE, LEAST_WORDS = 6.0, 3


def other_language(question: np.ndarray | str | None, answer: np.ndarray | str | None) -> bool:
    """The evidence of :class:`Languages` for two proses speaks for two languages, on both sides clearly."""
    if question is None or answer is None:
        return False
    if isinstance(question, str) or isinstance(answer, str):
        same_kind = isinstance(question, str) and isinstance(answer, str)
        return question != answer if same_kind else True
    q, a = int(np.argmax(question)), int(np.argmax(answer))
    return q != a and min(question[q] - question[a], answer[a] - answer[q]) >= EVIDENCE


def lcs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence (Hunt and Szymanski: near-linear when few tokens match)."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, w in enumerate(a):
        for j in reversed(where.get(w, ())):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k] = j
                links[k] = link
    out, at = [], links[-1] if links else None
    while at:
        out.append(at[:2])
        at = at[2]
    return out[::-1]


def _shingles(ws: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The answer holds nothing beyond the question, perhaps altered, repeated or introduced."""
    if len(question) < 2:
        return False
    allowed, own = max(1, len(question) // 8), set(question) | INTRODUCTIONS
    beyond = 0
    for w in answer:  # most answers have more words of their own than a copy may
        beyond += w not in own
        if beyond > allowed + 0.4 * len(question):
            return False
    q, a = _shingles(question), _shingles(answer)
    if len(q & a) * 4 < len(q):
        return False
    rest, first = answer, True
    while rest:
        hit = lcs(question, rest)
        if len(hit) < (0.7 if first else 0.6) * len(question):
            break
        first = False
        taken = {j for _, j in hit}
        rest = [w for j, w in enumerate(rest) if j not in taken]
    extra = [w for w in rest if w not in INTRODUCTIONS]
    return not first and len(extra) <= allowed


class Refusals:
    """Aligns sentences with templates of refusals.

    A sentence is read as the sequence of kinds of its words; templates are sequences
    of kinds with slots in between, and a template holds when the longest common
    subsequence of both is the template. An answer refuses when a sentence does and
    no sentence says anything else.
    """

    def __init__(self, templates: tuple[str, ...] = REFUSALS) -> None:
        self._templates = templates
        self._known: dict[str, str] = {}

    def _kind(self, word: str) -> str:
        """The kinds of a word, none in most cases; a word with an apostrophe may be two."""
        m = _KINDS.fullmatch(word)
        k = m.lastgroup if m else "".join(map(self._kind, word.split("'"))) if "'" in word else ""
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[word] = k
        return k

    def _match(self, sentence: str) -> bool | None:
        """True: a refusal; False: speaks of answering and no more; null: says something."""
        known = self._known
        tokens = _TOKENS.findall(sentence)
        if sentence.isascii() or not _HAN.search(sentence):
            kinds = "".join([known[w] if w in known else self._kind(w) for w in tokens])
        else:  # no spaces between words
            kinds = "".join(m.lastgroup for m in _KINDS.finditer(sentence))
        about = set(kinds) - {"N", "U"}
        if not about:
            return None
        words = len(tokens) + len(_HAN.findall(sentence)) // 2
        if len(kinds) < 2 and words > 2 or len(kinds) * 6 < words:
            return None
        if _IF.match(sentence) or _TURN.search(sentence) and not about & {"P"}:
            return None
        person, short = bool(about & {"I", "P"}), words <= SHORT_WORDS
        for t in self._templates:
            if len(t) <= len(kinds) and (t not in _NEEDS_PERSON or person or short and t in _SHORT) and len(lcs(t, kinds)) == len(t):
                return True
        return False

    def __call__(self, answer: str) -> bool:
        refused, text = False, answer.lower().replace("’", "'")
        # most answers say something at once
        end = _SENTENCES.search(text)
        first = text[: end.start()] if end else text
        if "```" not in first and WORD.search(first) and self._match(_NAMES.sub("x", first)) is None:
            return False
        for s in _SENTENCES.split(_NAMES.sub("x", text)):
            if not WORD.search(s):
                continue
            m = self._match(s)
            if m is None:
                return False
            refused |= m
        return refused


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but white space, marks or a placeholder."""
    if answer is None:
        return True
    if "<" not in answer and "`" not in answer and _SOME_WORDS.search(answer):  # more words than any placeholder has
        return False
    text = re.sub(r"^```\w*$|<[^>]*>", " ", answer, flags=re.M)
    ws = [w for w in WORD.findall(text.lower()) if w.strip("_")]
    return not ws or " ".join(ws) in PLACEHOLDERS


class Defects:
    """Tells what is wrong with an answer beside its question, the ending apart; made once per task."""

    def __init__(self, limit: int = 50_000) -> None:
        self._refusals, self._languages = Refusals(), Languages()
        self._questions: dict[str, tuple] = {}
        self._limit = limit

    def _question(self, q: str) -> tuple:
        if q not in self._questions:
            if len(self._questions) > self._limit:
                self._questions.clear()
            self._questions[q] = WORD.findall(q.lower()), self._languages.evidence(prose(q))
        return self._questions[q]

    def __call__(self, question: str | None, answer: str | None) -> str | None:
        """The defect of one answer, or null; tested in the order ``empty, copy, refusal, other_language``.

        A null question can be neither copied nor differ in language.
        """
        if is_empty(answer):
            return "empty"
        if question:
            words, language = self._question(question)
            if is_copy(words, WORD.findall(answer.lower())):
                return "copy"
        if self._refusals(answer):
            return "refusal"
        if question:
            said = prose(answer)
            if (len(said) >= LEAST_WORDS or any(map(_HAN.search, said))) and other_language(language, self._languages.evidence(said)):
                return "other_language"
        return None


def with_question(results: DataFrame, questions: DataFrame, hot_share: int = 1000) -> DataFrame:
    """``results`` with the text of their question; no row is lost or doubled.

    Question ids that own more than one in ``hot_share`` results are at most
    ``hot_share`` many; their questions alone are broadcast, the rest are joined by
    a shuffle, so a hot question never gathers in one task.
    """
    q = questions.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("q_id")).agg(F.min("question").alias("question"))
    r = results.select(F.col("result_id"), F.col("question_id"), F.col("answer"))
    per_id = r.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    total = r.agg(F.count(F.lit(1)).alias("total"))
    hot = per_id.join(F.broadcast(total), F.col("n") * hot_share > F.col("total") + 10 * hot_share).select("question_id")
    hot = write_through(hot, "hot-questions")
    hot_q = q.join(F.broadcast(hot), F.col("q_id") == hot["question_id"], "left_semi")
    part = lambda how: r.join(F.broadcast(hot), "question_id", how)
    return (
        part("left_anti").join(q, F.col("question_id") == F.col("q_id"), "left")
        .unionByName(part("left_semi").join(F.broadcast(hot_q), F.col("question_id") == F.col("q_id"), "left"))
        .select("result_id", "question", "answer")
    )


def defects(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per defective result: ``result_id, defect``.

    ``results``: ``result_id, question_id, answer``; ``questions``: ``id, question``;
    other columns are ignored. A result whose question is unknown or null is tested
    for what does not need the question. Repeated questions count once; repeated
    results are repeated. Empty tables give an empty result. An answer without another
    defect is ``truncated`` when its ending is broken off; how words go on is counted
    over all answers.
    """

    def make():
        tokens, first = E.Tokens(), Defects()

        def run(cols):
            rows = []
            for i, q, a, h in zip(cols["result_id"], cols["question"], cols["answer"], cols["text_hash"]):
                d = first(q, a)
                shape = E.COMPLETE if d else E.shape(a, tokens)
                if d or shape is not E.COMPLETE:
                    rows.append((i, d, h, *shape))
            return dict(zip(("result_id", "defect", "text_hash", *E.SHAPE), zip(*rows) if rows else ((),) * (len(E.SHAPE) + 3)))

        return run

    given = with_question(results, questions).withColumn("text_hash", F.xxhash64("answer"))
    shaped = write_through(stage(given, f"result_id long, defect string, text_hash long, {E.SHAPE_DDL}", make), "defects")
    answers = results.select(F.col("answer").cast("string").alias("answer"))
    n = answers.agg(F.count_distinct(F.xxhash64("answer"))).first()[0]
    judged = E.resolve(shaped.where("defect is null"), answers, "answer", n)
    broken = judged.where("lenient is not null").select("result_id", F.lit("truncated").alias("defect"))
    return shaped.where("defect is not null").select("result_id", "defect").unionByName(broken)
