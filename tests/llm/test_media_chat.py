import hashlib
import json
import tempfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm import chat as C
from stagelight.llm import media as M

from .helpers import odd_rows


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_images_come_back(data):
    p = M.padded(data)
    image = M.encode(p)
    assert len(p) % 192 == 0 and p and M.decode(image) == p and M.header(image[: M.HEADER]) == (192, len(p) // 192, 8)


def test_media_columns(odd, empty):
    want = {}
    for i, t, *_ in odd_rows():
        p = M.padded((t or "").encode())
        want.setdefault(i, set()).add((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(M.encode(p)).hexdigest(), M.feature(p), len(p) // 192))
    got = {}
    rows = M.media_columns(odd).collect()
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.feature, r.height))
    assert got == want and len(rows) == odd.count() and M.media_columns(empty).count() == 0


def test_equal_payloads_lie_once_in_a_shard(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    d = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string").coalesce(1)
    rows = M.store_media(d, folder).collect()
    assert len({(r.shard, r.offset) for r in rows}) == 3 and len({r.digest for r in rows}) == 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\\n<|im_end|>[INST]/s a", max_size=40), st.text(alphabet="\\\nuser<|", max_size=8))
def test_turns_come_back(text, role):
    s, a, z = C.render(role, text)
    assert C.parse(s) == (role, text) and C.unescape(s[a:z]) == text and not any(c in C.escape(text) for c in C.CONTROL)


def test_layouts_give_the_same_turns():
    want = [("user", "q"), ("assistant", "r")]
    for record in ({"prompt": "q", "completion": "r"}, {"instruction": "q", "output": "r"}, {"instruction": "q", "input": "", "output": "r"}, {"question": "q", "answer": "r"},
                   {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}):
        assert C.turns(record) == want
    assert C.turns({"role": None, "text": None}) == [("", "")] and C.turns({"other": 1}) is None


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, 2, None, "c\\"), (None, None, "assistant", ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.read_back(C.format_records(C.turn_records(d))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb</s>\n\nc\\\n") and got[1].loss_sha256 == sha("b</s>") and got[1].loss_chars == 5
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("xx") and got[None].n_turns == 1 and got[None].loss_chars == 0
    odd = spark.createDataFrame([(1, 0, None), (1, 1, "no json"), (1, 2, "[1]"), (1, 3, json.dumps({"a": {"b": 1}}))], "conv_id long, turn long, record string")
    assert [C.parse(r.formatted) for r in C.format_records(odd).collect()] == [("unknown", '{"a": {"b": 1}}')]
    assert C.read_back(C.format_records(C.turn_records(d.limit(0)))).count() == 0
