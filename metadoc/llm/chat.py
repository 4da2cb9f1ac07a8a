"""Conversations as one forest of turns: turns that conversations begin with alike are stored once.

A node is a turn after certain turns before it. Nodes are laid out depth first along one sequence of
tokens; each has the place of its tokens there, the position its first token would have if its
conversation stood alone, and the intervals of the sequence that its tokens may attend to: its
ancestors', merged where they lie side by side, so that there is one per fork at most.

All steps are joins and sorts of turns; conversations are never gathered into one row. The owner of a
node is the least conversation it occurs in. Owners never decrease along a path, which gives a short sort
key for depth-first order: the runs of equal owners on the way to the node.
"""

import base64
import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from metadoc.llm.shared import materialize, small

#: The strings that mark turns, and how a turn of each role begins and ends.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
_CONTROL = (re.compile(r"(<)(\\*)(/?s>|</?(?:SYS|ROLE)>>)"), re.compile(r"(\[)(\\*)(/?INST\])"))
_ESCAPED = (re.compile(r"(<)\\(\\*)(/?s>|</?(?:SYS|ROLE)>>)"), re.compile(r"(\[)\\(\\*)(/?INST\])"))
#: A node that more conversations read than this is dealt out in copies, one per so many of them.
READERS = 1 << 12


def escape(text):
    """``text`` without control strings: a backslash goes in after the first character of each."""
    for pattern in _CONTROL:
        text = pattern.sub(r"\1\\\2\3", text)
    return text


def unescape(text):
    for pattern in _ESCAPED:
        text = pattern.sub(r"\1\2\3", text)
    return text


def segments(role, text):
    """Head, body and tail of a formatted turn."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER[0]}{escape(json.dumps(role))}\n", OTHER[1]
    return head, escape(text), tail


def parse(formatted):
    """Role and text of a formatted turn."""
    if formatted.startswith(OTHER[0]):
        role, _, body = formatted[len(OTHER[0]):].partition("\n")
        return json.loads(unescape(role)), unescape(body[:len(body) - len(OTHER[1])])
    for role, (head, tail) in MARKS.items():
        if formatted.startswith(head):
            return role, unescape(formatted[len(head):len(formatted) - len(tail)])
    raise ValueError(f"no turn begins with {formatted[:20]!r}")


@lru_cache(maxsize=2)
def _encoding(path, pattern):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _turns(df, conv, turn, role, text):
    """``(conv, conv_id, seq, role, text, node, parent, tree)`` per turn; nodes are hashes of their paths."""
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    rows = df.select(
        F.unhex(F.md5(name)).alias("conv"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def chain(batches):
        conv, key, tree, seq = None, b"", b"", 0
        for pdf in batches:
            out = []
            for c, r, t in zip(pdf["conv"], pdf["role"], pdf["text"]):
                if c != conv:
                    conv, key, tree, seq = c, b"", None, 0
                head = r.encode("utf-8", "replace")
                digest = hashlib.blake2b(key, digest_size=16)
                digest.update(len(head).to_bytes(8, "big") + head + t.encode("utf-8", "replace"))
                parent, key = key, digest.digest()
                tree = tree or key
                out.append((seq, key, parent, tree))
                seq += 1
            made = pd.DataFrame(out, columns=["seq", "node", "parent", "tree"])
            yield pd.concat([pdf.reset_index(drop=True), made], axis=1)

    return rows.mapInPandas(chain, "conv binary, role string, text string, seq long, node binary, parent binary, tree binary")


def _ordered(paths):
    """``(node, order)`` for the nodes that a conversation owns; ``paths`` has ``(conv, seq, node, owner)``."""

    def walk(batches):
        conv, done, owner, length = None, b"", None, 0
        for pdf in batches:
            out = []
            for c, node, o in zip(pdf["conv"], pdf["node"], pdf["owner"]):
                if c != conv:
                    conv, done, owner, length = c, b"", o, 0
                if o != owner:
                    # A run that ends sorts after its owner's own nodes, the longer one first.
                    done += owner + b"\x01" + (2**64 - 1 - length).to_bytes(8, "big")
                    owner, length = o, 0
                length += 1
                if o == c:
                    out.append((node, done + owner + b"\x00" + length.to_bytes(8, "big")))
            yield pd.DataFrame(out, columns=["node", "order"])

    return paths.repartition("conv").sortWithinPartitions("conv", "seq").mapInPandas(walk, "node binary, order binary")


def _attention(paths):
    """``(node, position, ancestors)`` of owned nodes; ``paths`` has ``(conv, seq, node, owner, nth, start, n_tokens)``."""

    def walk(batches):
        conv, position, spans = None, 0, []
        for pdf in batches:
            out = []
            for c, node, o, nth, start, n in zip(
                    pdf["conv"], pdf["node"], pdf["owner"], pdf["nth"], pdf["start"], pdf["n_tokens"]):
                if c != conv:
                    conv, position, spans = c, 0, []
                if o == c:
                    out.append((node, position, [dict(zip(("start", "end", "first", "last"), s)) for s in spans]))
                position += n
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + n, spans[-1][2], nth)
                else:
                    spans.append((start, start + n, nth, nth))
            yield pd.DataFrame(out, columns=["node", "position", "ancestors"])

    return paths.repartition("conv").sortWithinPartitions("conv", "seq").mapInPandas(
        walk, "node binary, position long, ancestors array<struct<start:long,end:long,first:long,last:long>>")


def _coded(rows, path, pattern):
    """Tokens of each node; head, body and tail are encoded apart, so that the mask has whole tokens."""

    def code(batches):
        for pdf in batches:
            encode = _encoding(path, pattern).encode_ordinary
            out = []
            for role, text in zip(pdf["role"], pdf["text"]):
                head, body, tail = (encode(s) for s in segments(role, text))
                ids = np.asarray(head + body + tail, "<u4")
                loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                out.append((len(ids), *loss, ids.tobytes()))
            made = pd.DataFrame(out, columns=["n_tokens", "loss_start", "loss_end", "ids"])
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), made], axis=1)

    kinds = {name: kind for name, kind in rows.dtypes if name != "text"}
    return rows.mapInPandas(code, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", n_tokens long, loss_start long, loss_end long, ids binary")


def forest(df, vocabulary, pattern, conv="conv_id", turn="turn", role="role", text="text"):
    """The nodes of all conversations, and the node each conversation ends with.

    Nodes: ``(tree, node, parent, depth, role, nth, start, n_tokens, position, ancestors, loss_start,
    loss_end, ids)``; ``nth`` counts nodes and ``start`` tokens along the whole sequence, an interval of
    ``ancestors`` has the tokens ``start`` to before ``end``, which are those of the nodes ``first`` to
    ``last``; the loss is on tokens ``loss_start`` to ``loss_end`` of the node (an assistant's text),
    ``ids`` are little-endian 32-bit integers. Ends: ``(conv_id, node)``. Turns go by ``turn``, equal ones by role and text; null roles and texts are empty;
    rows without a conversation form one. Other columns are not looked at; no rows give no rows.
    ``vocabulary`` is a file of byte-level ranks at the same place on all executors.
    """
    turns = materialize(_turns(df, conv, turn, role, text), "turns")
    owners = materialize(turns.groupBy("node").agg(F.min("conv").alias("owner")), "owners")
    paths = materialize(turns.select("conv", "seq", "node").join(owners, "node"), "paths")
    content = turns.join(owners, "node").filter(F.col("conv") == F.col("owner")).select(
        "tree", "node", "parent", F.col("seq").alias("depth"), "role", "text")
    rows = content.join(_ordered(paths), "node").repartitionByRange("order").sortWithinPartitions("order")
    coded = materialize(_coded(rows, vocabulary, pattern).withColumn("part", F.spark_partition_id()), "nodes")
    # Places along the sequence: sums within the parts of the sort, behind the sums of the parts before.
    parts = coded.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("nodes"))
    before = Window.orderBy("part")
    ahead = parts.select(
        "part", (F.sum("n").over(before) - F.col("n")).alias("ahead"), (F.sum("nodes").over(before) - F.col("nodes")).alias("nodes"))
    inside = Window.partitionBy("part").orderBy("order")
    places = coded.select(
        "node", "n_tokens", "part", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("within"),
        F.row_number().over(inside).alias("row")).join(F.broadcast(ahead), "part").select(
            "node", "n_tokens", (F.col("ahead") + F.col("within")).alias("start"),
            (F.col("nodes") + F.col("row") - 1).alias("nth"))
    places = materialize(places, "places")
    seen = _attention(paths.join(places, "node"))
    nodes = coded.drop("part", "order", "n_tokens").join(places, "node").join(seen, "node")
    ends = turns.groupBy("conv").agg(F.max_by("node", "seq").alias("node"))
    name = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    names = df.select(F.col(conv).alias("conv_id"), F.unhex(F.md5(name)).alias("conv")).distinct()
    return materialize(nodes, "forest"), materialize(ends.join(names, "conv").select("conv_id", "node"), "ends")


def _wanted(nodes, ends):
    """``(tip, nth)``: the nodes that make up each conversation, by their places; one row per turn read."""
    own = F.struct(F.col("nth").alias("first"), F.col("nth").alias("last"))
    spans = F.transform("ancestors", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    tips = ends.select("node").distinct().join(nodes.select("node", "nth", "ancestors"), "node")
    return tips.select(F.col("node").alias("tip"), F.explode(F.concat(spans, F.array(own))).alias("span")).select(
        "tip", F.explode(F.sequence("span.first", "span.last")).alias("nth"))


def _read(nodes, ends, readers=READERS):
    """``(tip, nth, ids, loss_start, loss_end)``: as many rows as ``_wanted`` has.

    Places are dense, so nodes are found by equality. A node that over ``readers`` conversations share, such
    as a common first turn, is stored in as many copies as keep each below that, and its readers are dealt
    out to the copies.
    """
    wanted = materialize(_wanted(nodes, ends), "turns-to-read")
    shared = wanted.groupBy("nth").agg(F.count("*").alias("n")).filter(F.col("n") > readers).select(
        F.col("nth").alias("hot"), F.ceil(F.col("n") / readers).cast("int").alias("copies"))
    shared = materialize(shared, "shared-turns")
    dealt = wanted.join(small(shared), F.col("nth") == F.col("hot"), "left").select(
        "tip", "nth", F.coalesce(F.pmod(F.xxhash64("tip"), F.col("copies")).cast("int"), F.lit(0)).alias("copy"))
    stored = nodes.select("nth", "ids", "loss_start", "loss_end").join(small(shared), F.col("nth") == F.col("hot"), "left").select(
        "nth", "ids", "loss_start", "loss_end",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies") - 1, F.lit(0)))).alias("copy"))
    return dealt.join(stored, ["nth", "copy"]).drop("copy")


def read_back(nodes, ends, vocabulary, pattern):
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from a forest.

    The tokens of a conversation are those of the intervals its last node attends to, in the order of
    the sequence, and the node's own. Conversations that end with the same node are read once.
    """
    rows = _read(nodes, ends)

    def digest(batches):
        tip, state = None, None
        decode = None
        columns = ["tip", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row():
            return (tip, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for pdf in batches:
            decode = decode or _encoding(vocabulary, pattern).decode_bytes
            out = []
            for t, data, lo, hi in zip(pdf["tip"], pdf["ids"], pdf["loss_start"], pdf["loss_end"]):
                if t != tip:
                    if tip is not None:
                        out.append(row())
                    tip, state = t, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(data, "<u4").tolist()
                formatted = decode(ids).decode()
                role, text = parse(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    loss = unescape(decode(ids[lo:hi]).decode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            yield pd.DataFrame(out, columns=columns)
        if tip is not None:
            yield pd.DataFrame([row()], columns=columns)

    read = rows.repartition("tip").sortWithinPartitions("tip", "nth").mapInPandas(
        digest, "tip binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return ends.join(read, F.col("node") == F.col("tip")).drop("node", "tip")
