"""Rewording of observer phrases, and short texts cut out of longer ones, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Phrase patterns and their replacements, applied in this order.
OBSERVER = [
    (r"\b[Tt]he participant(s)? is being asked\b", "You are being asked"),
    (r"\b[Tt]he participant(s)? was asked\b", "You were asked"),
    (r"\b[Tt]he participant(s)? is now ready\b", "You are now ready"),
    (r"\b[Tt]he participant(s)? has not\b", "You have not"),
    (r"\b[Tt]he participant(s)? have not\b", "You have not"),
    (r"\b[Tt]he participant(s)? is\b", "You are"),
    (r"\b[Tt]he participant(s)? are\b", "You are"),
    (r"\b[Tt]he participant(s)? was\b", "You were"),
    (r"\b[Tt]he participant(s)? were\b", "You were"),
    (r"\b[Tt]he participant(s)? has\b", "You have"),
    (r"\b[Tt]he participant(s)? have\b", "You have"),
    (r"\b[Tt]he slice (is|was) explaining\b", "Currently explaining"),
    (r"\b[Tt]he slice (is|was) (explaining|discussing|covering)\b", "Currently"),
    (r"\b[Tt]he slice (is|was|explains|discusses|covers|contains)\b", "This section"),
    (r"\b[Tt]he discussion (is|was) (centered on|focused on|about)\b", "The conversation is about"),
    (r"\b[Tt]he discussion (is|was) at\b", "The conversation is at"),
    (r"\b[Tt]he discussion (explores|covers|addresses|is focused on)\b", "The conversation"),
    (r"\b[Pp]articipants (are|were) (debating|sharing|discussing)\b", "People $1 $2"),
    (r"\b[Pp]articipants (are|were|have|debate|discuss)\b", "People $1"),
    (r"\b[Tt]he conversation (discusses|covers|explores|spans)\b", "The thread"),
    (r"\b[Tt]he tutor (is|was|has|explains)\b", "The tutor"),
    (r"\b[Tt]he learner (is|was|has)\b", "The learner"),
    (r"\b[Nn]o one has yet\b", "Nothing has yet"),
    (r"\b[Tt]he cluster\b", "This section"),
    (r"\b[Tt]his slice\b", "This section"),
    (r"\bPeople (\w+ing)\b", "People are $1"),
]
#: What a text must hold for any pattern of OBSERVER to match; the first that matches finds the text as it came.
MARKS = ("articipant", "slice", "he discussion", "he conversation", "he tutor", "he learner", "o one has yet", "he cluster", "People ")
SUMMARY_LEADS = [
    (r"^[Tt]he slice (discusses|explains|covers|is about|outlines)\s+", "The session $1 "),
    (r"^[Tt]his section (discusses|explains|covers|is about|outlines)\s+", "The session $1 "),
    (r"^[Tt]his section\s+", "The session covers "),
    (r"^[Tt]he slice\s+", "The session covers "),
]
NEXT_LEADS = (
    "the next step would be to ",
    "the next actionable step is to ",
    "the next step is to ",
    "next step: ",
    "next: ",
    "continue by ",
    "should ",
    "need to ",
)


def clean_voice(text: Column) -> Column:
    return T.let(text, _voiced)


def _voiced(text: Column) -> Column:
    out = T.strip(text)
    for pattern, said in OBSERVER:
        out = F.regexp_replace(out, pattern, said)
    return T.collapse(F.when(T.contains_any(text, MARKS), out).otherwise(text))


def clean_lines(text: Column) -> Column:
    """``clean_voice`` line by line."""
    return T.strip(F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), _voiced), "\n"))


def clean_summary(text: Column) -> Column:
    out = clean_voice(text)
    for pattern, said in SUMMARY_LEADS:
        out = F.regexp_replace(out, pattern, said)
    return T.strip(out)


def clean_items(items: Column) -> Column:
    """The non-blank items of a list, cleaned."""
    return F.filter(F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: ~T.blank(x)), _voiced), lambda x: x != "")


def without_stop(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+\z", "")


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def next_from_text(text: Column) -> Column:
    """What follows the first phrase of ``NEXT_LEADS`` (in that order) that the text holds; else empty."""

    def after(t: Column, low: Column, lead: str) -> Column:
        rest = lambda at: without_stop(T.strip(F.substr(t, at + len(lead))))
        return T.let(F.locate(lead, low), lambda at: F.when(at > 0, T.let(rest(at), lambda r: F.when(r != "", capital(r)))))

    said = F.struct(text.alias("t"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    return T.let(said, lambda s: F.coalesce(*[after(s["t"], s["low"], lead) for lead in NEXT_LEADS], F.lit("")))


def distinct_sentences(parts: Column) -> Column:
    """Cleaned sentences of 12 characters and more; of those that tell the same, the first."""
    return T.told_once(F.filter(F.transform(parts, _voiced), lambda s: F.length(s) >= 12))


def position(state: Column, context: Column, summary: Column, topic: Column) -> Column:
    """Where a conversation stands, from cleaned texts: state and context merged, else the
    summary, else the topic."""
    merged = F.array_join(distinct_sentences(F.concat(T.sentences(state), T.sentences(context))), " ")
    return F.coalesce(
        T.full(merged), T.full(clean_summary(summary)),
        F.when(topic != "", F.concat(F.lit("The session covers "), without_stop(topic), F.lit("."))), F.lit(""),
    )
