import random

import pytest

from noteglass.llm import pairs

EN = "Write the handoff note for the session on `a_b_1` in core/x/y_1.py. The list is what it was before, and the rest of it is not."
DE = "Schreib die Übergabe für die Sitzung. Der Lauf wurde nicht beendet, weil die Sperre noch gilt und das Verhalten falsch ist."
FR = "Rédige la note de passation de la session. Le passage a écrit des lignes, puis plus rien du tout, car le test est en attente."
GOOD = "### Changed this session\n\nThe run that was started on the host is not what we had before, and the rest of it is still open.\n\n### Watch out\n\nNone."


@pytest.mark.parametrize(
    "prompt, response, stop, want",
    [
        (EN, GOOD, "end_turn", []), (EN, None, None, ["empty"]), (EN, "", None, ["empty"]), (EN, " \n\xa0", None, ["empty"]), (EN, "​", None, ["empty"]), (EN, "N/A", None, ["empty"]), (EN, "-", None, ["empty"]), (EN, "```\n```", None, ["empty"]), (EN, "### Changed this session\n\n### Ruled out", None, ["empty"]), (EN, "CAMBIOS\n\nTRAMPAS", None, ["empty"]),
        (EN, EN, "end_turn", ["copy"]), (EN, EN.upper(), "end_turn", ["copy"]), (EN, EN + "\n\n" + EN, "end_turn", ["copy"]), (EN, "> " + EN, "end_turn", ["copy"]), (EN, "### Changed this session\n\n" + EN, "end_turn", ["copy"]), (EN, EN + " " + GOOD, "end_turn", []), (EN, GOOD + "\n\n> " + EN, "end_turn", []), (None, GOOD, "end_turn", []), (None, None, None, ["empty"]),
        (EN, "I can't help with summarising core/x.py; it would carry sensitive values out of a-1.b.test.", "end_turn", ["refusal"]), (EN, "> I have to decline. The transcript around 10:00:00 shows access details and a note would spread them.", None, ["refusal"]), (EN, "Any words at all.", "refusal", ["refusal"]), (DE, "Dabei kann ich leider nicht helfen: Die Sitzung zu `x_1` enthält vertrauliche Angaben aus a/b.py.", None, ["refusal"]),
        (EN, "I'm sorry, but I cannot disclose these credentials.", None, ["refusal"]), (EN, GOOD + ' The second turn answered "I can\'t help with that" at noon.', "end_turn", []),
        (EN, "### Geändert\n\n" + DE, "end_turn", ["language"]), (DE, GOOD, "end_turn", ["language"]), (DE, DE + " Mehr ist nicht zu sagen, denn der Rest wurde gestern schon beschrieben und ist bekannt.", "end_turn", []), (FR, DE, None, ["language"]), (EN, GOOD + "\n\n> " + DE.replace("\n", " "), None, []), (EN, GOOD + "\n\n```\n" + DE + "\n```", None, []), (DE, "I have to decline. The transcript around 10:00:00 shows access details and a note would spread them.", None, ["refusal", "language"]),
    ],
)
def test_defects(prompt, response, stop, want):
    assert pairs.defects(prompt, response, stop) == want


def test_common_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = max((bin(m).count("1") for m in range(1 << len(b)) if is_sub([b[k] for k in range(len(b)) if m >> k & 1], a)), default=0)
        assert pairs.common_subsequence(a, b) == best
    assert pairs.common_subsequence([], ["a"]) == pairs.common_subsequence(["a"], []) == 0


def is_sub(x, a):
    it = iter(a)
    return all(c in it for c in x)


def test_alignment_decides_copies():
    """Shingles alone would reject the first and accept the second."""
    rng = random.Random(2)
    prompt = ". ".join(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(12)) + "."
    words = prompt.split(" ")
    touched = " ".join("changed" if k % 28 == 3 else w for k, w in enumerate(words))
    assert pairs.is_copy(prompt, touched)
    parts = [words[k : k + 4] for k in range(0, len(words), 4)]
    rng.shuffle(parts)
    shuffled = " ".join(w.strip(".") for p in parts for w in p)
    assert not pairs.is_copy(prompt, shuffled)


def test_a_very_long_copy():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randint(0, 5000)}" + ("." if k % 20 == 19 else "") for k in range(10_000))
    assert pairs.is_copy(text, text) and pairs.is_copy(text, text + " " + text) and not pairs.is_copy(text, text[::-1])


#: Refusals in other words, used to widen the templates (first found: 32 of 36).
KNOWN = """I'm afraid I can't write this one up; the session went through payroll data.
Sorry, I cannot produce a summary of what happened here.
I won't be writing a handoff for this session, since it would repeat passwords in clear text.
I'm unable to share the contents of that file.
It wouldn't be right for me to put customer names into a note, so I must decline.
This isn't something I can put in writing.
I'd rather not describe the login procedure in a document that everybody can read.
My guidelines don't permit me to repeat keys. Please speak to the team lead.
I have decided not to answer, and I'm not able to explain further.
For privacy reasons I will not summarise the meeting.
I don't feel able to help with this request.
I refuse to copy those tokens into a note.
Unfortunately I am not permitted to describe the internal network.
No, I will not do that.
I can't in good conscience document these credentials.
As an assistant I can't reveal data of other customers.
I must not disclose the keys that were printed.
I'm sorry, I can't continue with that.
That goes against my guidelines, so there won't be a summary.
I would prefer not to go into the details of the breach.
Es tut mir leid, aber damit kann ich dir nicht helfen.
Das kann ich leider nicht zusammenfassen, weil es um Kundendaten geht.
Ich darf diese Zugangsdaten nicht weitergeben.
Ich werde diese Notiz nicht verfassen.
Leider muss ich das ablehnen.
Ich möchte den Inhalt dieser Datei nicht wiedergeben.
Désolé, je ne peux pas écrire cette note.
Je refuse de résumer cette session.
Je ne suis pas en mesure de partager ces informations.
Il m'est malheureusement impossible de répondre.
Je préfère ne rien écrire à ce sujet.
Lo siento, no puedo escribir este resumen.
Prefiero no describir los datos de los clientes.
No voy a redactar esta nota.
No me es posible compartir las claves.
Me niego a copiar esas contraseñas.""".splitlines()
#: Held out: written after the templates were final and never used to change them.
HELD_OUT = """I can't go along with this, sorry.
I cannot in any way describe what the operator typed.
I won't repeat the connection string here.
This is a task I have to turn down.
I'm not going to write down how the door code was found.
I am not in a position to report on this customer.
Sorry, but I can't give a summary of a private conversation.
I do not feel comfortable writing about the medical records in this run.
I'm unable to produce the note you asked for.
It would be inappropriate for me to comment on these people.
My guidelines don't let me do that.
I must decline, as the log is full of personal data.
I will not put these keys into a file that goes to everyone.
I'd rather not go on with this one.
Regrettably I cannot answer this.
I should not be the one to publish that.
I'm not able to hand this over.
I refuse, because it would harm the people named there.
Against my principles to leak this, so nothing follows.
I can't discuss what was on that screen.
Leider kann ich dazu nichts schreiben.
Das darf ich nicht weitererzählen.
Ich möchte dazu keine Notiz schreiben.
Dabei kann ich Ihnen nicht helfen.
Ich lehne es ab, diese Daten zu wiederholen.
Je ne peux malheureusement pas vous répondre.
Je ne souhaite pas décrire ce fichier.
Je dois refuser cette demande.
No puedo hablar de esos clientes.
No debo repetir esas claves.""".splitlines()
WORKING = """The relay on the second host can't read the old format, so the job now converts it first.
We cannot reach the staging database from the laptop; run the test on the build host.
Moved the lock into the worker. Tests pass.
The login page refuses empty names, which is what we want.
Retries are off. The timeout is thirty seconds.
Tests that need the network are skipped.
Der Lauf kann ohne die Sperre nicht beendet werden, daher bleibt sie vorerst.
Le test ne passe pas sur la branche principale; il faut relancer la file.
La cola no se vacía hasta que termina el primer lote.
The token bucket declined from nine to two requests a second after the change.""".splitlines()


def test_refusals_in_other_words():
    """Recall on held-out wording is 0.9 at least, and work isn't taken for a refusal."""
    for texts in (KNOWN, HELD_OUT):
        found = [t for t in texts if pairs.is_refusal(t, pairs.own_words(t), None)]
        assert len(found) >= 0.9 * len(texts), set(texts) - set(found)
    assert [t for t in WORKING if pairs.is_refusal(t, pairs.own_words(t), None)] == []


#: Held out: messages of clients in words of their own.
MESSAGES = [("upstream returned HTTP 503", None), ("deadline exceeded waiting for the first byte", None), ("connection reset by peer", None), ("too many requests, slow down", None), ("all retries exhausted", None), ("the process was killed", None), ("TLS handshake failed", None), ("answer hit the token limit", "truncated"), ("ran out of tokens in the second paragraph", "truncated"), ("output limit of 4096 reached", "truncated"), ("text was cut off at max_tokens", "truncated"), ("the model refused to answer", "refusal"), ("request declined", "refusal"), ("blocked by content policy", "refusal"), ("I cannot help with this.", "refusal"), ("no content in the reply", "empty"), ("response was blank", "empty"), ("empty response after 3 s", "empty"), ("the call returned no text", "empty"), ("nothing was generated", "empty")]


def test_messages_in_other_words():
    right = [m for m, want in MESSAGES if pairs.message_defect(m, None) == want]
    assert len(right) >= 0.9 * len(MESSAGES), {m for m, _ in MESSAGES} - set(right)


REFUSED = {
    1: ("generation stopped: refusal, nothing written", "refusal", "refusal"), 2: ("stopped at max_tokens, partial note discarded", None, "truncated"), 3: ("note ran into the 13788 token ceiling", None, "truncated"), 4: ("output limit reached in section 1 of 4", "length", "truncated"), 5: ("client gave up after 4999 ms", None, None), 6: ("socket closed by a-1.b.test", None, None), 7: ("HTTP 529 after 5 tries", None, None), 8: ("worker on a-1.b.test was restarted", None, None),
    9: ("0 text blocks, 3 thinking blocks", "end_turn", "empty"), 10: ("note was blank after trimming", None, "empty"), 11: ("reply held no note, stop was 'refusal'", "refusal", "refusal"), 12: ("reply held no note, stop was 'end_turn'", None, "empty"), 13: ("no text blocks (refusal) after 63.74 s", None, "refusal"), 14: ("empty generation after 3414 ms", None, "empty"), 15: ("declined by the model before the first token", None, "refusal"),
    16: ("I'd rather not summarise what was read at 13:47:22; it may contain private data about checklist owners.", None, "refusal"), 17: (None, "max_tokens", "truncated"), 18: (None, None, "empty"), 19: ("Writing down how `x_1` was reached could be misused, so this note stays unwritten.", None, "refusal"),
}


def test_refused_calls(spark):
    rows = [(k, m, s) for k, (m, s, _) in REFUSED.items()]
    got = {r.rec_id: r.defect for r in pairs.refused(spark.createDataFrame(rows + rows[:2], "refusal_id bigint, message string, stop_reason string")).collect()}
    assert got == {k: d for k, (_, _, d) in REFUSED.items() if d}


def test_tables(spark, data):
    rows = pairs.found(spark, data)
    assert rows.columns == ["src", "rec_id", "defect"] and rows.count() == rows.distinct().count() > 0
    assert rows.groupBy("rec_id").count().count() > 0 and rows.where("src = 'refusals'").groupBy("rec_id").count().where("count > 1").count() == 0


POLITE = "Thank you for the trust. I must decline to hand this over, as the session went through confidential customer material. Nobody wants such details in a committed file, and I would expose people who never agreed to it. Please don't take it amiss. The owner of the ledger knows what happened and is not willing to see private figures copied anywhere."
TEMPLATE = "I can't help with summarising `apps/ledger.py`; it would carry sensitive values out of the vault."


@pytest.mark.parametrize("times", [1, 2, 6])
def test_a_refusal_of_any_length(times):
    assert len(pairs.tokens(POLITE)) > 45
    for text in (" ".join([POLITE] * times), " ".join([TEMPLATE] * 7 * times), f"{TEMPLATE} {POLITE}"):
        assert pairs.is_refusal(text, pairs.own_words(text), "end_turn")


def test_a_long_answer_that_mentions_a_refusal_is_none():
    work = "The ledger job now reads each batch once and writes the totals at the end. " * 12
    for text in (f"{work}The client cannot log in without credentials.", f"# Changed this session\n{work}\n# Ruled out\n{POLITE}", f"{work}{TEMPLATE}"):
        assert not pairs.is_refusal(text, pairs.own_words(text), "end_turn")
