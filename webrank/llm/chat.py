"""Chat formatting: typed content parts, a reversible template, its loss mask and its parser."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
BEGIN, END, INST, TSNI = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[(?=(?:IMAGE|AUDIO|DOCUMENT):)")
#: What the parser tells apart: an escaped character, a control string, a placeholder.
LEXEME = re.compile(r"\\(?P<escaped>.)|(?P<control></?s>|\[/?INST\])|\[(?P<kind>IMAGE|AUDIO|DOCUMENT):(?P<number>\d+)\]", re.DOTALL)
#: No lexeme is longer, so a parser may hold back this many characters of what it has.
HELD = 40
#: Markdown references to a file in a text, by the kind of part that they become.
IMAGE, AUDIO, DOCUMENT = "png|jpe?g|gif|webp", "wav|mp3|flac|ogg", "pdf|docx?|pptx?|epub"
REFERENCE = rf"!?\[[^\[\]\n]{{0,200}}\]\([^()\x20\x09-\x0D]{{1,500}}\.(?:{IMAGE}|{AUDIO}|{DOCUMENT})\)"
PART = "struct<type:string,text:string,ref:string,size:long>"
ATTACHED = "array<struct<kind:string,ref:string,tokens:long,source:string>>"
SEGMENT = f"conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments {ATTACHED}"


def escape(text: str) -> str:
    """Put a backslash before each control string and backslash, so that a text can't close or open a turn."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


class Visitor:
    """Flattens parts in order: text is escaped, other kinds become numbered placeholders with a token count.

    A part without a size counts as one tile, `seconds` of audio or one page.
    """

    def __init__(self, image_tile: int = 1024, tile_tokens: int = 256, audio_rate: int = 25, page_tokens: int = 512, seconds: int = 30):
        self.image_tile, self.tile_tokens, self.audio_rate, self.page_tokens, self.seconds = image_tile, tile_tokens, audio_rate, page_tokens, seconds

    def visit(self, parts) -> tuple[str, list[tuple[str, str | None, int, str | None]]]:
        out, self.attached = [], []
        for part in parts:
            out.append(getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part))
        return "".join(out), self.attached

    def attach(self, kind: str, part, tokens: int) -> str:
        """`text` of a part that isn't text is its form in the source, which a reader puts back."""
        self.attached.append((kind, part["ref"], tokens, part["text"]))
        return f"[{kind.upper()}:{len(self.attached) - 1}]"

    def size(self, part, default: int) -> int:
        return default if part["size"] is None or pd.isna(part["size"]) else int(part["size"])

    def visit_text(self, part) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part) -> str:
        """size: pixels; a tile of image_tile ** 2 pixels makes tile_tokens tokens."""
        return self.attach("image", part, -(-self.size(part, 1) // self.image_tile**2) * self.tile_tokens)

    def visit_audio(self, part) -> str:
        """size: milliseconds."""
        return self.attach("audio", part, -(-self.size(part, 1000 * self.seconds) * self.audio_rate // 1000))

    def visit_document(self, part) -> str:
        """size: pages."""
        return self.attach("document", part, self.size(part, 1) * self.page_tokens)

    def visit_other(self, part) -> str:
        raise ValueError(f"unknown part type {part['type']}")


def typed_parts(text: Column) -> Column:
    """The typed parts of a text: its references to images, audio and documents, and the text between them, in order."""
    none = F.lit(None)

    def part(kind: Column, source: Column, ref: Column) -> Column:
        return F.struct(kind.alias("type"), source.alias("text"), ref.cast("string").alias("ref"), none.cast("long").alias("size"))

    def of(x: Column) -> Column:
        ref = F.regexp_extract(x["ref"], r"\]\((.*)\)$", 1)
        kind = F.when(ref.rlike(rf"\.(?:{IMAGE})$"), "image").when(ref.rlike(rf"\.(?:{AUDIO})$"), "audio").otherwise("document")
        return F.array(part(F.lit("text"), x["piece"], none), F.when(x["ref"].isNotNull(), part(kind, x["ref"], ref)))

    text = F.coalesce(text, F.lit(""))
    zipped = F.arrays_zip(F.split(text, REFERENCE, -1).alias("piece"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("ref"))
    return F.filter(F.flatten(F.transform(zipped, of)), lambda x: x.isNotNull() & (x["text"] != ""))


def format_turns(turns: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end, attachments for turns(conv_id, turn, role, parts).

    A turn reads <s>[INST]role[/INST]content</s>; the loss mask is the content of assistant turns, as
    code points of `formatted`.  A null role is an empty one and null parts are none.  The row of a
    turn doesn't depend on others, so a conversation of any length is formatted by many tasks.
    """
    visitor = visitor or Visitor()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(batch.conv_id, batch.turn, batch.role, batch.parts):
                body, attached = visitor.visit([] if parts is None else parts)
                head = f"{BEGIN}{INST}{escape(role or '')}{TSNI}"
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                rows.append((conv, turn, f"{head}{body}{END}", *loss, attached))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    rows = turns.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.col("parts").cast(f"array<{PART}>"))
    out = rows.mapInPandas(work, SEGMENT.replace("conv_id long, turn long", "conv_id string, turn string"))
    return out.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})


class Parser:
    """Reads turns from a formatted conversation that is fed in pieces, cut anywhere, and digests them.

    It knows nothing but the text: a turn begins and ends with unescaped control strings.  The k-th
    placeholder stands for the k-th attachment, whose source (or reference) is put back.  It holds a
    few characters besides what it is fed.
    """

    #: What may follow, by state: the control string and the next state.
    NEXT = {"outside": (BEGIN, "begun"), "begun": (INST, "role"), "role": (TSNI, "body"), "body": (END, "outside")}

    def __init__(self):
        self.state, self.rest, self.turns, self.attached = "outside", "", 0, deque()
        self.digest, self.tokens, self.formatted = hashlib.sha256(), 0, 0

    def say(self, text: str) -> None:
        if text:
            if self.state not in ("role", "body"):
                raise ValueError(f"text {self.state} a turn: {text[:40]!r}")
            self.digest.update(text.encode("utf-8", "surrogatepass"))

    def feed(self, text: str, attachments=(), last: bool = False) -> None:
        self.formatted += len(text)
        self.attached.extend(attachments)
        text, at = self.rest + text, 0
        safe = len(text) if last else max(0, len(text) - HELD)
        for m in LEXEME.finditer(text):
            if m.start() >= safe:
                break
            self.say(text[at : m.start()])
            at = m.end()
            if m["escaped"] is not None:
                self.say(m["escaped"])
            elif m["kind"]:
                part = self.attached.popleft()
                if part["kind"].upper() != m["kind"]:
                    raise ValueError(f"placeholder {m[0]} stands for {part['kind']}")
                self.tokens += int(part["tokens"])
                self.say(part["source"] or part["ref"] or "")
            else:
                control, after = self.NEXT[self.state]
                if m["control"] != control:
                    raise ValueError(f"{m['control']} where {control} must stand")
                if self.state in ("role", "body"):
                    self.say("\n")
                self.turns += control == END
                self.state = after
        if at < safe:
            self.say(text[at:safe])
            at = safe
        self.rest = text[at:]
        if last and (self.state != "outside" or self.attached):
            raise ValueError(f"the conversation ends {self.state} a turn, {len(self.attached)} attachments left")


def plain(text: str, attachments) -> str:
    """The source of a piece of formatted content: unescaped, references put back."""

    def source(m: re.Match) -> str:
        if m["kind"]:
            part = attachments[int(m["number"])]
            return part["source"] or part["ref"] or ""
        return m["escaped"]

    return LEXEME.sub(source, text)


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens: a row per conversation.

    Turns are parsed from the formatted text, as one stream, and unescaped; the mask gives the loss
    texts.  A conversation's rows are sorted by turn (then by text, so ties and repeated rows have one
    order) and pass through a parser and running digests one at a time: memory doesn't grow with a
    conversation, though a digest is made by one task by its nature.
    A null conv_id is a conversation of its own; null turns come first; no rows give no conversations.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parser, loss, masked, attached = None, None, None, 0, 0

        def row():
            parser.feed("", last=True)
            return (now, parser.turns, parser.digest.hexdigest(), masked, loss.hexdigest(), parser.formatted, attached, parser.tokens)

        for batch in batches:
            done = []
            for conv, text, start, end, parts in zip(batch.conv_id, batch.formatted, batch.loss_start, batch.loss_end, batch.attachments):
                if parser is None or now != conv:
                    if parser is not None:
                        done.append(row())
                    now, parser, loss, masked, attached = conv, Parser(), hashlib.sha256(), 0, 0
                parser.feed(text, parts)
                under = plain(text[start:end], parts)
                masked += len(under)
                attached += len(parts)
                loss.update(under.encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=columns)
        if parser is not None:
            yield pd.DataFrame([row()], columns=columns)

    rows = segments.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end", "attachments")
    out = rows.mapInPandas(digest, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
    return out.withColumn("conv_id", F.expr("try_cast(conv_id as bigint)"))
