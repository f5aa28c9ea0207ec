"""Parameters of the operators, and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the sentence tri-state.

    ``rule`` picks how a scored sentence becomes blocked (0), passed (1) or grey (2):

    * ``guardrail`` - blocked when LABEL_0 at or over ``high``, passed when LABEL_1
      with an unsafe probability at or under ``low``, grey in between;
    * ``service``   - only LABEL_0 can block or be grey, LABEL_1 always passes;
    * ``paper``     - the unsafe probability alone decides, with strict comparisons.
    """

    rule: str
    high: float
    low: float


GUARDRAIL = Thresholds("guardrail", 0.97, 0.04)
SERVICE = Thresholds("service", 0.97, 0.00002)
PAPER = Thresholds("paper", 0.92, 0.04)

POST_THRESHOLD = 0.5


@dataclass(frozen=True)
class WindowParams:
    size: int = 510
    stride: int = 256
    threshold: float = POST_THRESHOLD


@dataclass(frozen=True)
class RetrievalParams:
    bm25_top_k: int = 3
    vector_top_k: int = 3
    hybrid_top_k: int = 5
    relevance: float = 0.35
    k1: float = 1.5
    b: float = 0.75


SERVICE_RETRIEVAL = RetrievalParams(bm25_top_k=5, vector_top_k=5, hybrid_top_k=10)


@dataclass(frozen=True)
class ChunkParams:
    size: int = 512
    overlap: int = 50


@dataclass(frozen=True)
class RequestLimits:
    """Accepted range of each numeric request field, both ends included."""

    ranges: dict = field(
        default_factory=lambda: {
            "temperature": (0.0, 2.0),
            "top_p": (0.0, 1.0),
            "max_tokens": (1, None),
            "presence_penalty": (-2.0, 2.0),
            "frequency_penalty": (-2.0, 2.0),
            "max_context_turns": (1, 20),
        }
    )


MAX_HISTORY_TURNS = 50
HISTORY_DEFAULT = 10
CONTEXT_DEFAULT = 5
SESSION_TTL_DAYS = 30
REGISTRY_REFRESH_SECONDS = 300

# Texts and markers that results must agree on.
STANDARD_REFUSAL = "根据相关法律法规以及道德伦理规范，我无法提供关于这个问题的回答，建议换一个话题。"
AUDIT_ERROR_MESSAGE = "后拦截检查出错，为确保安全已中断响应。"
FRONT_BLOCK_PREFIX = "前拦截触发"
POST_BLOCK_PREFIX = "后拦截触发"
ACTION_REJECT = "拒绝"
ACTION_GUIDE = "正面引导"
ACTION_ANSWER = "直接回答"
NO_RESULT_TEXT = "暂无相关检索结果。"
TRUNCATED_NOTICE = "\n\n[检索结果过长，已截取前部分内容]"
MAX_CONTEXT_CHARS = 4000
MID_TOKEN = "<|mid_token|>"
JUDGE_FAILED = "000"
JUDGE_STOPPED = "111"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
IM_START_ID = 151644
IM_START_EXCEPTION_ID = 77960
PAD_ID = 151643
IGNORE_LABEL = -100
SAFETY_MODEL = "safety-filter"
RESULT_QUERY = "查询问题: "
RESULT_COUNT = "\n检索到%d条相关信息:"
RESULT_ITEM = "\n[结果%d]"
RESULT_CONTENT = "内容: "
RESULT_SOURCE = "来源: "
RESULT_URL = "链接: "
RESULT_TITLE = "标题: "
RESULT_SCORE = "相关度: %.4f"
RESULT_SIMILARITY = "相似度: %.4f"
RESULT_METADATA = "\n检索信息:"
CONTEXT_HEAD = "Context:\n"
CONTEXT_BULLET = "- "
CONTEXT_QUESTION = "\n\nQuestion: "
CONTEXT_TAIL = "\nAnswer using the context above."
