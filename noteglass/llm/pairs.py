"""Defective prompt and response pairs.

Row-local, over Arrow batches; nothing is shuffled but the truncated ones' keys.

* ``empty``: nothing is left of the response without headings, fences, marks and
  placeholders.
* ``copy``: prompt and response tokens are aligned. Shingles of three tokens give the part
  of the response that the prompt contains; where it is at least half (``CONTAINED``), every
  sentence is aligned with the prompt by a longest common subsequence, and these must cover
  the response (``COPY``). So a copy with a word changed here and there is one, and a text
  that shuffles the prompt's phrases isn't. Its own headings and quote marks don't count,
  nor does letter case; a prompt repeated is a copy.
* ``refusal``: sentences of the response, without what it quotes, align with refusal
  templates (longest common subsequence of a template's tokens, ``ALIGNED`` of it at least),
  those sentences make up a good part of it (``REFUSING``), whatever its length, and it has
  no worked-out sections; or the stop reason says so.
* ``language``: the function words of prompt and response belong to different languages.
  Quotes, code, identifiers and headings are left out; too few function words decide nothing.
* ``truncated``: as truncation finds it.

Refused calls are told apart by their message, aligned in the same way with templates of
what clients say (technical failure, token limit, refusal, nothing there); the template that
aligns with most tokens decides. A call that failed for technical reasons has no defect;
every other one has just one.

Defined cases: null responses are empty, null prompts are never copied and have no
language; a response of other columns' type can't occur; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteglass.llm import truncation
from noteglass.llm.tokens import slices
from noteglass.session import table

#: Ways to refuse, as stems of general wording; other words may stand between theirs.
REFUSALS = [
    "i can't help with", "i cannot help with", "i can't help you", "i can't assist", "i cannot assist", "i can't do that", "i cannot do that", "isn't something i can do", "is not something i can do", "not something i am able to", "i'm not able to", "i am not able to", "i'm unable to", "i am unable to", "i won't", "i will not", "i must decline", "i have to decline", "i need to decline", "i decline to", "i refuse to",
    "i'd rather not", "i would rather not", "i'd prefer not to", "i prefer not to", "i don't feel comfortable", "i do not feel comfortable", "i'm not comfortable", "nothing i feel comfortable", "i'm not willing to", "i am not willing to", "outside what i am willing to", "outside what i can", "beyond what i can", "i'm not allowed to", "i am not permitted to", "i shouldn't", "i should not", "i mustn't", "i must not",
    "it would not be appropriate for me to", "it wouldn't be appropriate for me to", "would be inappropriate for me to", "my guidelines don't let me", "my guidelines do not allow me", "my instructions forbid", "against my guidelines", "against my principles", "against policy", "i can't share", "i cannot share", "i can't provide", "i cannot provide", *(f"i {n} {v}" for n in ("can't", "cannot") for v in ("write", "produce", "create", "describe", "summarise", "summarize", "document", "discuss", "continue", "answer", "give", "go into")), "i can't disclose", "i cannot disclose", "i can't reveal", "i can't comply", "i cannot comply", "i can't fulfil this request", "request i can't fulfil", "request i will decline", "request i'll pass on", "i'll have to pass",
    "could be misused", "can be misused", "for security reasons", "for privacy reasons", "there will be no answer", "no answer will follow", "no summary will follow", "will remain unwritten", "won't be written by me", "has to come from somebody with clearance", "please ask the owner instead", "this request has been declined",
    "dabei kann ich nicht helfen", "damit kann ich nicht helfen", "das kann ich nicht", "ich kann nicht helfen", "ich kann das nicht schreiben", "ich möchte nicht", "möchte ich nicht", "das möchte ich nicht schreiben", "das darf ich nicht", "ich darf nicht", "darf ich nicht", "ich werde nicht", "ich muss ablehnen", "ich lehne ab", "das lehne ich ab", "muss ich ablehnen", "das muss ich ablehnen", "ich verweigere", "gebe ich keine auskunft", "ich gebe keine auskunft", "es wäre nicht angemessen", "meine richtlinien erlauben nicht",
    "je ne peux pas", "je ne peux pas vous aider", "je ne suis pas en mesure de", "je préfère ne pas", "je refuse de", "je dois refuser", "je dois décliner", "je ne souhaite pas", "je ne veux pas", "je ne dois pas", "il m'est impossible de", "il ne serait pas approprié", "mes consignes ne permettent pas", "je regrette mais",
    "no puedo", "no puedo ayudar con eso", "prefiero no", "no me es posible", "no me corresponde", "me niego a", "debo negarme", "debo declinar", "no voy a", "no debo", "no estoy en condiciones de", "no sería apropiado", "mis normas no permiten", "lo siento pero no",
]
#: What clients say of a call that left no note, by what it means; of equal alignments the first class wins.
MESSAGES = {
    "technical": ["http error", "http status", "http", "gateway timeout", "timed out", "request timeout", "deadline exceeded", "connection reset", "connection refused", "connection closed", "connection lost", "socket closed", "socket error", "broken pipe", "network unreachable", "host unreachable", "name resolution failed", "handshake failed", "service unavailable", "server error", "overloaded", "rate limit", "too many requests", "quota exceeded", "gave up after", "giving up after", "retries exhausted", "after retries", "after tries", "was restarted", "was killed", "process died", "worker lost", "out of memory", "cancelled by client"],
    "truncated": ["max_tokens", "max tokens", "max_output_tokens", "maximum of tokens", "token limit", "token ceiling", "token budget", "out of tokens", "output limit", "length limit", "limit reached", "ceiling reached", "too long", "was cut off", "partial discarded", "partial answer", "context window full"],
    "refusal": ["refusal", "refused", "refuses", "declined", "declines", "blocked by policy", "safety filter", "content filter", "content policy", *REFUSALS],
    "empty": ["0 text blocks", "no text blocks", "no text", "no content", "no output", "no answer", "no note", "nothing written", "nothing returned", "nothing generated", "empty response", "empty generation", "empty reply", "empty", "blank", "only whitespace", "zero tokens", "0 tokens", "without text"],
}
#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of to and is it that for in on with was by not at from this be has still only before when are were an or which then all now what why where if so until after but".split(),
    "de": "der die das und ist nicht ein eine für auf mit wird von zu dem den aber noch wenn bei wurde im wir haben hat dabei danach mehr nur beim denn bis ohne weil als sie ich über statt sind gar".split(),
    "fr": "le la les et est un une que pour dans du des il au pas plus par qui à sur ce en deux nous avons vu ont lancé puis rien car où cela tout mais ne sait jusqu sans ses cette je de session note ma on".split(),
    "es": "el la los y es un una que para en del las no se por con lo de cuando más donde dos veces solo vio porque pero así antes luego nada ahora lugar todo al hasta desde sin esta este sobre sesión nota quien aquí".split(),
}
PLACEHOLDERS = set("n/a na none null nil tbd todo empty vacío leer vide - . … ​".split())
FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
HEADING = re.compile(r"^[ \t>]*(?:#{1,6}[ \t].*|#{1,6}|\*\*[^*\n]*\*\*:?|[-=_*]{3,})[ \t]*$", re.M)
TITLES = re.compile(r"^[ 	>#*]*(?:" + "|".join(n for names in truncation.SECTIONS.values() for n in names) + r")[ 	*:]*$", re.M | re.I)
QUOTE_MARKS = re.compile(r"^[ \t]*>[ \t]?", re.M)
QUOTED_LINES = re.compile(r"^[ \t]*>.*$", re.M)
QUOTES = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“")
CODE = re.compile(r"`[^`\n]*`")
TABLE = re.compile(r"^[ \t]*\|.*$", re.M)
_WORDY = re.compile(r"\w")
TOKEN = re.compile(r"\w+(?:['’]\w+)?")
SENTENCES = re.compile(r"(?<=[.!?;])\s+|\n+")
WORD = re.compile(r"(?<![\w./\-])[^\W\d_]+(?![\w/\-]|\.\w)")

COPY, CONTAINED, LANGUAGE_WORDS, REFUSING, ALIGNED = 0.95, 0.5, 3, 0.2, 0.75


def lines_only(response: str) -> str:
    """The response without its headings."""
    return TITLES.sub("", HEADING.sub("", response))


def is_empty(response: str | None) -> bool:
    headed = nothing = False
    for line in (response or "").replace("```", " ").split("\n"):
        if HEADING.match(line) or TITLES.match(line):
            headed = True
            continue
        for part in line.split():
            token = part.strip("*_.:;,()[]<>​﻿⁠\xa0 ").casefold()
            if token == "none":
                nothing = True
            elif token and token not in PLACEHOLDERS and _WORDY.search(token):
                return False
    return not (nothing and headed)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.casefold())


def shingles(words: list[str], size: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, by bits: one word operation for each token of a."""
    places: dict[str, int] = {}
    for j, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for word in a:
        hit = places.get(word)
        if hit is not None:
            both = free & hit
            free = ((free + both) | (free - both)) & full
    return len(b) - free.bit_count()


def is_copy(prompt: str | None, body: str) -> bool:
    """body: the response without headings."""
    a = tokens(prompt or "")
    sentences = [w for part in SENTENCES.split(QUOTE_MARKS.sub("", body) if ">" in body else body) if (w := tokens(part))]
    b = [w for part in sentences for w in part]
    if not a or len(b) < 4:
        return False
    known, held, reached, bare = shingles(a), 0, 0, (1 - CONTAINED) * len(b)
    for k in range(len(b) - 2):
        if (b[k], b[k + 1], b[k + 2]) in known:
            held += k + 3 - max(k, reached)
            reached = k + 3
        elif k + 1 - held > bare:
            return False
    if held < CONTAINED * len(b):
        return False
    missing, most = 0, (1 - COPY) * len(b)
    for words in sentences:
        missing += len(words) - common_subsequence(a, words)
        if missing > most:
            return False
    return True


class Templates:
    """Templates as token lists, found by their tokens and aligned by longest common subsequence."""

    def __init__(self, texts: list[str]):
        self.lists = [tokens(t) for t in texts]
        self.having: dict[str, list[int]] = {}
        for k, words in enumerate(self.lists):
            for w in set(words):
                self.having.setdefault(w, []).append(k)

    def best(self, words: list[str]) -> int:
        """Most tokens of one template that align with a sentence, 0 if none aligns well enough."""
        votes: dict[int, int] = {}
        for w in set(words) & self.having.keys():
            for k in self.having[w]:
                votes[k] = votes.get(k, 0) + 1
        most = 0
        for k, n in votes.items():
            template = self.lists[k]
            if n >= ALIGNED * len(set(template)) and len(template) > most:
                got = common_subsequence(words, template)
                if got >= ALIGNED * len(template):
                    most = max(most, got)
        return most


_REFUSALS = Templates(REFUSALS)
_MESSAGES = {name: Templates(texts) for name, texts in MESSAGES.items()}


def own_words(body: str) -> str:
    """The response without fences and quotes; one that is nothing but a quote is taken at its word."""
    if "```" in body:
        body = FENCED.sub(" ", body)
    if ">" in body:
        unquoted = QUOTED_LINES.sub("", body)
        body = unquoted if unquoted.strip() else QUOTE_MARKS.sub("", body)
    return QUOTES.sub(" ", body)


def is_refusal(response: str, own: str, stop: str | None) -> bool:
    """own: the own words of the response, of any length."""
    if (stop or "").strip().casefold() == "refusal":
        return True
    if len(TITLES.findall(response)) >= 2:
        return False
    refusing = total = 0
    for sentence in SENTENCES.split(own.replace("’", "'")):
        words = tokens(CODE.sub(" ", sentence))
        total += len(words)
        refusing += len(words) if _REFUSALS.best(words) else 0
    return refusing > 0 and refusing >= REFUSING * total


_OWNER: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words:
        _OWNER.setdefault(_word, []).append(_language)


def language(own: str) -> str | None:
    """Language of a text by its function words, or None if they don't tell."""
    body = CODE.sub(" ", TABLE.sub(" ", own) if "|" in own else own)
    count = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for word in WORD.findall(body.casefold()):
        owners = _OWNER.get(word)
        if owners:
            for owner in owners:
                count[owner] += 1 / len(owners)
    first, second = sorted(count, key=count.get, reverse=True)[:2]
    return first if count[first] >= LANGUAGE_WORDS and count[first] >= 1.5 * count[second] + 1 else None


def defects(prompt: str | None, response: str | None, stop: str | None) -> list[str]:
    """The defects that one pair shows by itself."""
    if is_empty(response):
        return ["empty"]
    body = lines_only(response)
    if is_copy(prompt, body):
        return ["copy"]
    own = own_words(body)
    found = ["refusal"] if is_refusal(response, own, stop) else []
    asked = language(own_words(lines_only(prompt or "")))
    answered = language(own) if asked else None
    return found + ["language"] * bool(asked and answered and asked != answered)


def judge(rows: DataFrame) -> DataFrame:
    """(src, rec_id, defect) of rows (src, rec_id, prompt, response, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "response"):
                src, ids, out = [], [], []
                for s, i, prompt, response, stop in zip(*(batch.column(c).to_pylist() for c in ("src", "rec_id", "prompt", "response", "stop")), strict=True):
                    for d in defects(prompt, response, stop):
                        src.append(s), ids.append(i), out.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(src, type=pa.string()), pa.array(ids, type=pa.int64()), pa.array(out, type=pa.string())], names=["src", "rec_id", "defect"])

    return rows.select("src", "rec_id", "prompt", "response", "stop").mapInArrow(run, "src string, rec_id bigint, defect string")


#: Tokens of a message that aren't part of a path or host name.
MESSAGE_WORD = re.compile(r"(?<![\w./\-])\w+(?:['’]\w+)?(?![\w/\-]|\.\w)")


def message_defect(message: str | None, stop: str | None) -> str | None:
    """Defect of a refused call; None if it failed for technical reasons."""
    reason = (stop or "").strip().casefold()
    told = "refusal" if reason == "refusal" else "truncated" if reason in truncation.LIMIT_STOPS else None
    words = MESSAGE_WORD.findall((message or "").replace("’", "'").casefold())
    if not words:
        return told or "empty"
    scores = {name: found.best(words) for name, found in _MESSAGES.items()}
    best = max(scores.values())
    if not best:
        return told or "refusal"  # the model's own words
    kind = next(name for name, n in scores.items() if n == best)
    if kind == "empty" and scores["refusal"]:
        kind = "refusal"  # says why nothing is there
    return (told or kind) if kind != "technical" else None


def refused(rows: DataFrame) -> DataFrame:
    """(src, rec_id, defect) of refused calls (refusal_id, message, stop_reason)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, message, stop in zip(*(batch.column(c).to_pylist() for c in ("refusal_id", "message", "stop_reason")), strict=True):
                defect = message_defect(message, stop)
                if defect:
                    ids.append(i), out.append(defect)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(out, type=pa.string())], names=["rec_id", "defect"])

    judged = rows.select("refusal_id", "message", "stop_reason").mapInArrow(run, "rec_id bigint, defect string")
    return judged.select(F.lit("refusals").alias("src"), "rec_id", "defect").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """(src, rec_id, defect) of all pairs, once each."""
    notes = table(spark, folder, "distillations").select(F.lit("distillations").alias("src"), F.col("dist_id").alias("rec_id"), "prompt", F.col("note").alias("response"), F.col("stop_reason").alias("stop"))
    cut = truncation.cut_texts(spark, folder).where("src = 'distillations'").select("src", "rec_id", F.lit("truncated").alias("defect"))
    return judge(notes).unionByName(cut).distinct().unionByName(refused(table(spark, folder, "refusals").select("refusal_id", "message", "stop_reason")))
