"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A Template declares each role's marks and whether its text bears loss, and which role may follow which. Every row becomes segments (text,
loss) on the map side: mark, escaped text, mark. Inside texts each of \\ [ < ] gets a \\ before it, so a control string, which
begins with [ or <, never arises from a text; taking these away again is exact. Rows meet first in blocks of BLOCK_TURNS turns of a
conversation, where each block also becomes the map from every state to the state after it; blocks are then joined to
conversations, and their maps composed. Those maps are what makes the machine run in parts. A conversation's text is one value of
the result, so its bytes meet in one row at last; nothing but its segments does.

Defined results: null text is empty; null role is the empty role. Roles that the template doesn't know are marked by name, bear no
loss and make the conversation invalid; invalid conversations are formatted all the same, with valid false. Turns stand in ascending
order, null first, rows of an equal turn by role, then text; repeated rows are all formatted. Rows of null conv_id are one conversation.
An empty table gives an empty result. Other columns are not used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.tables import table

#: Turns of a conversation that first meet in one group.
BLOCK_TURNS = 64


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role; after: the roles that may follow a role, None for the beginning."""

    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", True)})
    after: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    other: Role = field(default_factory=lambda: Role("[TURN:", "[/TURN]"))

    @property
    def states(self) -> list[str | None]:
        """The beginning and a state per role; one more, from which nothing leads away, is the invalid one."""
        return [None, *self.roles]

    def step(self, state: Column, role: Column) -> Column:
        """The state after a role."""
        bad = len(self.states)
        table_ = [[self.states.index(r) if r in self.after.get(s, ()) else bad for r in self.roles] for s in self.states]
        row = F.lit(bad)
        for s, cells in enumerate(table_):
            cell = F.lit(bad)
            for r, target in zip(self.roles, cells, strict=True):
                cell = F.when(role == r, target).otherwise(cell)
            row = F.when(state == s, cell).otherwise(row)
        return row


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<\]])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _marks(template: Template, role: Column) -> tuple[Column, Column, Column]:
    """A role's opening and closing mark, and whether its text bears loss."""
    first, last, loss = F.concat(F.lit(template.other.open), escape(role), F.lit("]")), F.lit(template.other.close), F.lit(False)
    for name, own in template.roles.items():
        is_it = role == name
        first, last, loss = F.when(is_it, own.open).otherwise(first), F.when(is_it, own.close).otherwise(last), F.when(is_it, own.loss).otherwise(loss)
    return first, last, loss


def chat_format(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, valid and segments (array of text, loss), which joined are the formatted conversation."""
    template = template or Template()
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    first, last, loss = _marks(template, role_)
    segments = F.array(F.struct(first.alias("text"), F.lit(False).alias("loss")), F.struct(escape(text_).alias("text"), loss.alias("loss")), F.struct(last.alias("text"), F.lit(False).alias("loss")))
    rows = df.select(F.col(conv).alias("conv"), F.floor(F.col(turn) / BLOCK_TURNS).alias("block"), F.struct(F.col(turn).alias("turn"), role_.alias("role"), segments.alias("segments")).alias("row"))
    blocks = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    walk = lambda s: F.reduce("rows", F.lit(s), lambda at, row: template.step(at, row["role"]))
    n_states = len(template.states) + 1
    mapped = blocks.select("conv", F.struct("block", F.size("rows").alias("n"), F.array(*[walk(s) for s in range(n_states)]).alias("to"), F.flatten(F.transform("rows", lambda r: r["segments"])).alias("segments")).alias("part"))
    whole = mapped.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    end = F.reduce("parts", F.lit(0), lambda at, part: F.get(part["to"], at))
    return whole.select(
        F.col("conv").alias(conv),
        F.reduce("parts", F.lit(0).cast("long"), lambda n, part: n + part["n"]).alias("n_turns"),
        (end < n_states - 1).alias("valid"),
        F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
    )


def formatted(segments: str = "segments") -> Column:
    """The whole formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text: array of role, text."""
    template = template or Template()
    quote = lambda s: "\\Q" + s + "\\E"
    opens = "|".join([*(quote(r.open) for r in template.roles.values()), quote(template.other.open) + r"(?:[^\\\]]++|\\.)*+\]"])
    closes = "|".join(quote(r.close) for r in [*template.roles.values(), template.other])
    pattern = F.lit(rf"(?s)({opens})((?:[^\\\[<]++|\\.)*+)(?:{closes})")

    def turn(mark: Column, body: Column) -> Column:
        named = unescape(mark.substr(F.lit(len(template.other.open) + 1), F.length(mark) - len(template.other.open) - 1))
        for name, own in template.roles.items():
            named = F.when(mark == own.open, name).otherwise(named)
        return F.struct(named.alias("role"), unescape(body).alias("text"))

    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), turn)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat_format(given.unionByName(extra)).withColumns({"formatted": formatted(), "loss": loss_text()})
    turns = done.withColumn("turns", read_turns(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: SQL for op10's rows: turns by role and text, and the template's lengths (marks of a turn, and a code point per escaped character).
ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(regexp_replace(text, '[^\\\[<\]]', '', 'g')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 7 END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' ELSE false END) AS valid
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM given)
GROUP BY conv_id
"""
