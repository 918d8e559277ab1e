r"""Chat formatting with DataFrame functions only.

A finite-state machine over roles says which turn may follow which. A template
gives each role its opening marker and all turns one closing marker; texts are
escaped so that no marker can appear inside one, and can be read back.

Escapes: a backslash becomes two, ``###`` becomes ``\h`` and ``</turn>``
becomes ``\e``; in roles, a colon becomes ``\c``. In an escaped text each backslash therefore starts a pair, and
pairs are told apart by splitting at double backslashes, leftmost first.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles carry loss, and the order of roles that is valid.

    ``follows`` maps a state, which is the last role or ``start``, to the roles that may come next; a conversation
    may end in a state of ``final``.
    """

    opening: str = "### {role}: "
    closing: str = "</turn>\n"
    labels: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
HASHES, END, BACK = "###", "</turn>", "\\"
#: Stands before a role that the template has no label for.
UNLABELLED = BACK + "r"


def escape(text: Column) -> Column:
    """The text with control strings written as backslash pairs."""
    doubled = F.replace(text, F.lit(BACK), F.lit(BACK * 2))
    return F.replace(F.replace(doubled, F.lit(HASHES), F.lit(BACK + "h")), F.lit(END), F.lit(BACK + "e"))


def unescape(text: Column) -> Column:
    """The text that :func:`escape` got."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit(BACK + "h"), F.lit(HASHES)), F.lit(BACK + "e"), F.lit(END)), F.lit(BACK + "c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), BACK)


def _opening(role: Column, template: Template) -> Column:
    """The opening marker of a role. A role without a label shows itself, marked and escaped, colons too; a null role is an empty one."""
    label = F.coalesce(role, F.lit(""))
    shown = F.concat(F.lit(UNLABELLED), F.replace(escape(label), F.lit(":"), F.lit(BACK + "c")))
    for name, said in template.labels.items():
        shown = F.when(label == name, F.lit(said)).otherwise(shown)
    before, after = template.opening.split("{role}")
    return F.concat(F.lit(before), shown, F.lit(after))


def valid(roles: Column, template: Template = DEFAULT) -> Column:
    """Whether an array of roles is accepted by the template's state machine."""

    def step(state: Column, role: Column) -> Column:
        to = F.lit("reject")
        for source, targets in template.follows.items():
            to = F.when((state == source) & role.isin(*targets), role).otherwise(to)
        return to

    return F.aggregate(F.transform(roles, lambda r: F.coalesce(r, F.lit(""))), F.lit("start"), step).isin(*template.final)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row a conversation: ``conv_id``, ``valid`` and ``segments``, an array of ``(text, loss)`` that joined are the formatted conversation.

    Rows go by turn, null turns first; rows of one turn by role, then text, so the result does not depend on how rows
    arrive; repeated rows are repeated turns. Null texts are empty. Rows with a null conversation id form one
    conversation. The order of roles decides ``valid`` only: every conversation is formatted. A conversation becomes
    one row, since its digest and its formatted text are one value: a task has to hold its longest conversation, which
    for null ids is all rows without one.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        loss = F.coalesce(t["role"].isin(*template.loss_roles), F.lit(False))
        return F.array(
            F.struct(_opening(t["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    return convs.select("conv_id", valid(F.transform("turns", lambda t: t["role"]), template).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, formatted, turns, loss_texts`` from the segments' text and loss flags alone: ``turns`` are ``(role, text)``."""
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    before, after = template.opening.split("{role}")

    def turn(x: Column) -> Column:
        # no marker can be inside the escaped text, and roles' labels have no marker either
        body = x.substr(F.lit(len(before) + 1), F.length(x))
        cut = F.instr(body, after)
        label = body.substr(F.lit(1), cut - 1)
        role = unescape(label.substr(F.lit(len(UNLABELLED) + 1), F.length(label)))
        for name, said in template.labels.items():
            role = F.when(label == said, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(body.substr(cut + len(after), F.length(body))).alias("text"))

    quoted = "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in template.closing)
    pieces = F.filter(F.split("formatted", quoted), lambda x: x != "")
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumn("formatted", joined).select("conv_id", "valid", "formatted", F.transform(pieces, turn).alias("turns"), lost.alias("loss_texts"))


def digest(read: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`read_back` found."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(F.encode(lost, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
