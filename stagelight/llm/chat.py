"""Chat formatting: records of any known layout become canonical turns, and turns become a reversible template.

A record's fingerprint is the hash of its nested field paths. It selects a declarative mapping (paths to roles and texts);
records of one fingerprint share the compiled mapping. Formatted turns are rows, so a conversation may be of any length.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import picked

#: Control strings of the template and of other common templates; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))

#: Layouts: field paths ([] is a list's element) and, in order, the turns they give as (role or path of the role, path of the text).
LAYOUTS: dict[tuple[str, ...], tuple[tuple[str, str], ...]] = {
    ("prompt", "completion"): (("user", "prompt"), ("assistant", "completion")),
    ("prompt", "response"): (("user", "prompt"), ("assistant", "response")),
    ("question", "answer"): (("user", "question"), ("assistant", "answer")),
    ("instruction", "output"): (("user", "instruction"), ("assistant", "output")),
    ("instruction", "input", "output"): (("user", "instruction+input"), ("assistant", "output")),
    ("system", "instruction", "output"): (("system", "system"), ("user", "instruction"), ("assistant", "output")),
    ("messages[].role", "messages[].content"): (("@messages[].role", "messages[].content"),),
    ("conversations[].from", "conversations[].value"): (("@conversations[].from", "conversations[].value"),),
    ("role", "text"): (("@role", "text"),),
    ("role", "content"): (("@role", "content"),),
}
#: Names of roles in other layouts; fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(p): m for p, m in LAYOUTS.items()}


def paths(value, at: str = "") -> list[str]:
    """Field paths of the leaves; an empty list or object has no path."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return list(dict.fromkeys(p for v in value for p in paths(v, f"{at}[]")))
    return [at]


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) of a record by the mapping of its fingerprint; None if no layout has its paths."""
    mapping = MAPPINGS.get(fingerprint(paths(record)))
    if mapping is None:
        return None
    out = []
    for role, source in mapping:
        if "[]" in source:
            top, leaf = source.split("[].")
            name = role.split("[].")[1]
            out += [(ROLES.get(r := text_of(x.get(name)), r), text_of(x.get(leaf))) for x in record[top]]
        else:
            r = text_of(record.get(role[1:])) if role[0] == "@" else role
            parts = [text_of(record.get(s)) for s in source.split("+")]
            out.append((ROLES.get(r, r), "\n\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]))
    return out


def escape(s: str) -> str:
    """No control string stands in the result; `unescape` gives s back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", s)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the bounds of its text; the loss mask is those bounds for the assistant."""
    head = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


#: A role may hold line breaks, which then follow a single backslash.
_TURN = re.compile(re.escape(BEGIN) + r"((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*)" + re.escape(END))


def parse(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    return unescape(m[1]), unescape(m[2])


FORMATTED = "conv_id long, turn long, part int, formatted string, loss_start int, loss_end int"


def format_records(records: DataFrame) -> DataFrame:
    """Records (conv_id, turn, record as JSON) to formatted turns (conv_id, turn, part, formatted, loss_start, loss_end).

    `part` numbers the turns of one record; the loss bounds are equal outside assistant turns. A NULL record or one that
    is no JSON object gives no turn; an object of an unknown layout is kept as one turn of role 'unknown' with the JSON as its
    text. NULL fields are empty. Ids and turns may be NULL or repeated, other columns are not read.
    """

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("conv_id", "turn", "part", "formatted", "loss_start", "loss_end")}
            for conv, turn, raw in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    continue
                found = turns(record)
                for part, (role, text) in enumerate([("unknown", raw)] if found is None else found):
                    s, a, z = render(role, text)
                    for k, v in zip(cols, (conv, turn, part, s, a, z if role == "assistant" else a)):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=list(cols))

    return picked(records, conv_id=records["conv_id"].cast("long"), turn=records["turn"].cast("long"), record="record").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through their partition in order (conv_id, turn, part, formatted), so a conversation may have any number
    of turns: only running digests are held. NULL ids are one conversation; a NULL turn stands first.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        out, now = {k: [] for k in names}, None

        def close():
            if now is not None:
                for k, v in zip(names, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])):
                    out[k].append(v)

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(names))
            for v in out.values():
                v.clear()
            return b

        for b in batches:
            for conv, s, a, z in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(s)
                loss = unescape(s[a:z])
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(s)
            yield batch()
        close()
        yield batch()

    ordered = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "part", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records of the layout role, text."""
    own = picked(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return own.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
