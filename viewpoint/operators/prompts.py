"""Prompt and response tables around summary generation.

Spark builds the request table (prompt text, chat wrapping, JSON payload) and
parses the response table; sending requests and running models stay outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instructions per template set and experiment (the mixed and
# single perspective wordings are the same text in each set).
API_LEFT = (
    'Produce a short, single-sentence summary of the left-leaning political perspective within the following texts. '
    'Respond only with the summary beginning with "The left": '
)
API_RIGHT = (
    'Produce a short, single-sentence summary of the right-leaning political perspective within the following texts. '
    'Respond only with the summary beginning with "The right": '
)
LOCAL_LEFT = (
    'Produce a short, single-sentence summary of the left-leaning political perspective within the following texts. '
    'Begin the summary with "The left": '
)
LOCAL_RIGHT = (
    'Produce a short, single-sentence summary of the right-leaning political perspective within the following texts. '
    'Begin the summary with "The right": '
)
TEMPLATES = [
    ("api", "mp_left_pred", API_LEFT),
    ("api", "mp_right_pred", API_RIGHT),
    ("api", "sp_left_pred", API_LEFT),
    ("api", "sp_right_pred", API_RIGHT),
    ("local", "mp_left_pred", LOCAL_LEFT),
    ("local", "mp_right_pred", LOCAL_RIGHT),
    ("local", "sp_left_pred", LOCAL_LEFT),
    ("local", "sp_right_pred", LOCAL_RIGHT),
]
# Which topic column each experiment summarises.
EXP_SOURCE = {"mp_left_pred": "alt_op", "mp_right_pred": "alt_op", "sp_left_pred": "left_op", "sp_right_pred": "right_op"}
# Decoding parameters of the API request.
API_PARAMS = {
    "max_tokens": 128,
    "top_p": 1,
    "top_k": 1,
    "presence_penalty": 0,
    "frequency_penalty": 0,
    "temperature": 0,
}
API_STOP = ["."]
API_CONTEXT = "truncate"
# Chat markers and the cleanup offsets after them.
MISTRAL_MARK, MISTRAL_SKIP = "[/INST]", 8
VICUNA_MARK, VICUNA_SKIP, VICUNA_TAIL = "ASSISTANT:", 11, 3


def instruction(template: Column, exp: Column) -> Column:
    """Instruction of a template set for an experiment, NULL for unknown ones."""
    out = F.lit(None).cast("string")
    for t, e, text in reversed(TEMPLATES):
        out = F.when((template == t) & (exp == e), F.lit(text)).otherwise(out)
    return out


def prompt_rows(topics: DataFrame, templates: tuple[str, ...] = ("api", "local"), exps: list[str] | None = None) -> DataFrame:
    """(row_id, template, exp, prompt = instruction + '\\n' + source text): one
    explode per topic over the experiments and template sets asked for; the
    instructions are constants of the plan, so there is no join."""
    items = [e for e in EXP_SOURCE if exps is None or e in exps]
    arr = F.array(*[F.struct(F.lit(e).alias("exp"), F.col(EXP_SOURCE[e]).alias("text")) for e in items])
    per_exp = topics.select("row_id", F.explode(arr).alias("x")).select("row_id", "x.exp", "x.text")
    rows = per_exp.select("row_id", F.explode(F.array(*[F.lit(t) for t in templates])).alias("template"), "exp", "text")
    prompt = F.concat(instruction(F.col("template"), F.col("exp")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return rows.select("row_id", "template", "exp", prompt.alias("prompt"))


def messages_json(prompt: Column) -> Column:
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))


def wrap_for_family(family: Column, prompt_col: str = "prompt") -> Column:
    """Model input by family: mistral '<s>[INST]...' text, vicuna 'USER: ...
    ASSISTANT:' text, chat families a JSON message list. NULL for other
    families; list those with :func:`family_error`."""
    inst_text = F.col(prompt_col)
    return (
        F.when(family == "mistral", F.concat(F.lit("<s>[INST]\n"), inst_text, F.lit("\n[/INST]\n")))
        .when(family == "vicuna", F.concat(F.lit("USER: "), inst_text, F.lit("\nASSISTANT:")))
        .when(family.isin("mixtral", "llama", "api"), messages_json(inst_text))
    )


def request_payload(model: Column, prompt: Column, user: Column, model_prefix: str = "") -> Column:
    """API request body as JSON text (fixed decoding parameters)."""
    return F.to_json(
        F.struct(
            F.concat(F.lit(model_prefix), model).alias("model"),
            *[F.lit(v).alias(k) for k, v in API_PARAMS.items()],
            F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
            F.array(*[F.lit(s) for s in API_STOP]).alias("stop"),
            F.lit(API_CONTEXT).alias("context_length_exceeded_behavior"),
            user.alias("user"),
        )
    )


def response_content(raw: Column) -> Column:
    """``choices[0].message.content`` of a response whose whole text is one JSON
    value, else NULL.

    Spark's JSON functions stop at the end of the first value, so the text is
    also read as the only element of an array and as a member of an object: text
    after the value breaks one of the two."""
    alone = (F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1) & F.get_json_object(
        F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"
    ).isNotNull()
    return F.when(alone, F.get_json_object(raw, "$.choices[0].message.content"))


def response_text(raw: Column) -> Column:
    """:func:`response_content`, 'Error' when the response does not parse or lacks it."""
    return F.coalesce(response_content(raw), F.lit("Error"))


# Families whose prompts are wrapped.
FAMILIES = ["mistral", "vicuna", "mixtral", "llama"]


def family_of(model: Column) -> Column:
    """Prompt family by name: 'mistral' and 'vicuna' are case-sensitive
    substrings, 'mixtral'/'llama' case-insensitive; NULL if none."""
    low = F.lower(model)
    return (
        F.when(model.contains("mistral"), F.lit("mistral"))
        .when(model.contains("vicuna"), F.lit("vicuna"))
        .when(low.contains("mixtral"), F.lit("mixtral"))
        .when(low.contains("llama"), F.lit("llama"))
    )


def cleanup_family_of(model: Column) -> Column:
    """Family whose output rule applies: all three names are case-sensitive, so
    'Meta-Llama-3' is prompted as llama and its output left alone."""
    return (
        F.when(model.contains("mistral"), F.lit("mistral"))
        .when(model.contains("vicuna"), F.lit("vicuna"))
        .when(model.contains("llama"), F.lit("llama"))
    )


def family_error(family: Column, model: Column) -> Column:
    """Why a row has no model input; NULL for the known families."""
    known = F.coalesce(family.isin(*FAMILIES, "api"), F.lit(False))
    return F.when(~known, F.concat(F.lit("unknown model family: "), F.coalesce(model, F.lit(""))))


def clean_output(text: Column, family: Column, parity: bool = False) -> Column:
    """Strip the echoed prompt / preamble from a local model's decoded output.

    mistral: text after '[/INST]' + 1; vicuna: text after 'ASSISTANT: ' minus the
    last 3 characters; llama: when it starts with 'here' (any case), text
    after the first ':'. With ``parity`` a missing marker behaves as Python's
    ``find() == -1`` (slice from 7 / 10); by default the text is kept."""
    m_at = F.instr(text, MISTRAL_MARK)
    v_at = F.instr(text, VICUNA_MARK)
    n = F.length(text)
    # 0-based Python slice starts; instr() is 1-based and 0 when absent.
    mistral = _py_slice(text, m_at - 1 + MISTRAL_SKIP, n)
    vicuna = _py_slice(text, v_at - 1 + VICUNA_SKIP, n - VICUNA_TAIL)
    if not parity:
        mistral = F.when(m_at > 0, mistral).otherwise(text)
        vicuna = F.when(v_at > 0, vicuna).otherwise(text)
    llama = F.when(F.lower(F.substring(text, 1, 4)) == "here", _py_slice(text, F.instr(text, ":"), n)).otherwise(text)
    return (
        F.when(family == "mistral", mistral)
        .when(family == "vicuna", vicuna)
        .when(family == "llama", llama)
        .otherwise(text)
    )


def _py_slice(text: Column, start: Column, end: Column) -> Column:
    """Python ``text[start:end]`` for 0 <= start, end measured from the left
    (negative ends already resolved by the caller)."""
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))


def assemble_predictions(
    requests: DataFrame, responses: DataFrame, keys: tuple[str, ...] = ("model", "row_id", "exp"), parity: bool = False
) -> DataFrame:
    """Prediction table: the rows of ``requests`` (keys..., and ``name``, the
    model's name, where it is a local model) plus pred, is_error, error and
    raw_response; one row per request.

    ``responses`` (keys..., raw, received): of several responses to a request the
    last by ``received`` counts, of those with the same one the largest text. A
    request without a name is an API request, whose response is a JSON body; a
    missing or unparseable one gives 'Error'. The output of a local model is
    cleaned by its family; a family that is not known is listed in ``error``, and
    a missing output is 'Error', too."""
    if "received" not in responses.columns:
        raise ValueError("responses need a column 'received' that orders those to one request")
    last = responses.groupBy(*keys).agg(F.max_by("raw", F.struct("received", "raw")).alias("raw_response"))
    out = requests.join(last, list(keys), "left")
    raw, name = F.col("raw_response"), F.col("name") if "name" in requests.columns else F.lit(None).cast("string")
    local = clean_output(raw, cleanup_family_of(name), parity)
    bad = F.when(name.isNotNull(), family_error(family_of(name), name))
    text = F.when(name.isNull(), response_content(raw)).when(bad.isNull(), local)
    out = out.select(*requests.columns, text.alias("_text"), bad.alias("_bad"), "raw_response")
    error = F.coalesce("_bad", F.when(raw.isNull(), F.lit("no response")).when(F.col("_text").isNull(), F.lit("unparseable response")))
    return out.select(
        *requests.columns, F.coalesce("_text", F.lit("Error")).alias("pred"), F.col("_text").isNull().alias("is_error"), error.alias("error"), "raw_response"
    )
