"""Tensor and model names: canonical roles, families, groups, quantisation labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical role by tensor name (fixed values).  A layer pattern stands before
#: `.weight` or `.bias`, with the layer's number in the place of #; the first that fits counts.
LAYER_ROLES = [
    ("model.layers.#.self_attn.q_proj", "attn.q"),
    ("model.layers.#.self_attn.k_proj", "attn.k"),
    ("model.layers.#.self_attn.v_proj", "attn.v"),
    ("model.layers.#.self_attn.o_proj", "attn.o"),
    ("model.layers.#.self_attn.qkv_proj", "attn.qkv"),
    ("model.layers.#.self_attn.dense", "attn.o"),
    ("model.layers.#.mlp.gate_proj", "mlp.gate"),
    ("model.layers.#.mlp.up_proj", "mlp.up"),
    ("model.layers.#.mlp.down_proj", "mlp.down"),
    ("model.layers.#.mlp.gate_up_proj", "mlp.gate_up"),
    ("model.layers.#.mlp.fc1", "mlp.fc1"),
    ("model.layers.#.mlp.fc2", "mlp.fc2"),
    ("model.layers.#.input_layernorm", "norm.in"),
    ("model.layers.#.post_attention_layernorm", "norm.post"),
    ("model.layers.#.pre_feedforward_layernorm", "norm.pre_ff"),
    ("model.layers.#.post_feedforward_layernorm", "norm.post_ff"),
    ("model.layers.#.self_attn.q_norm", "norm.q"),
    ("model.layers.#.self_attn.k_norm", "norm.k"),
    ("gpt_neox.layers.#.attention.query_key_value", "attn.qkv"),
    ("gpt_neox.layers.#.attention.dense", "attn.o"),
    ("gpt_neox.layers.#.mlp.dense_h_to_4h", "mlp.fc1"),
    ("gpt_neox.layers.#.mlp.dense_4h_to_h", "mlp.fc2"),
    ("gpt_neox.layers.#.input_layernorm", "norm.in"),
    ("gpt_neox.layers.#.post_attention_layernorm", "norm.post"),
    ("transformer.h.#.self_attention.query_key_value", "attn.qkv"),
    ("transformer.h.#.self_attention.dense", "attn.o"),
    ("transformer.h.#.mlp.dense_h_to_4h", "mlp.fc1"),
    ("transformer.h.#.mlp.dense_4h_to_h", "mlp.fc2"),
    ("transformer.h.#.input_layernorm", "norm.in"),
    ("transformer.h.#.ln_attn", "norm.in"),
    ("transformer.h.#.ln_mlp", "norm.post"),
    ("transformer.h.#.attn.c_attn", "attn.qkv"),
    ("transformer.h.#.attn.c_proj", "attn.o"),
    ("transformer.h.#.mlp.c_fc", "mlp.fc1"),
    ("transformer.h.#.mlp.c_proj", "mlp.fc2"),
    ("transformer.h.#.ln_1", "norm.in"),
    ("transformer.h.#.ln_2", "norm.post"),
    ("blk.#.attn_q", "attn.q"),
    ("blk.#.attn_k", "attn.k"),
    ("blk.#.attn_v", "attn.v"),
    ("blk.#.attn_output", "attn.o"),
    ("blk.#.attn_qkv", "attn.qkv"),
    ("blk.#.ffn_gate", "mlp.gate"),
    ("blk.#.ffn_up", "mlp.up"),
    ("blk.#.ffn_down", "mlp.down"),
    ("blk.#.attn_norm", "norm.in"),
    ("blk.#.ffn_norm", "norm.post"),
    ("blk.#.attn_q_norm", "norm.q"),
    ("blk.#.attn_k_norm", "norm.k"),
]
#: Roles outside the layers, by full name (fixed values).
GLOBAL_ROLES = [
    ("model.embed_tokens.weight", "embed"),
    ("gpt_neox.embed_in.weight", "embed"),
    ("transformer.word_embeddings.weight", "embed"),
    ("transformer.wte.weight", "embed"),
    ("lm_head.weight", "lm_head"),
    ("embed_out.weight", "lm_head"),
    ("model.norm.weight", "norm.final"),
    ("model.norm.bias", "norm.final"),
    ("gpt_neox.final_layer_norm.weight", "norm.final"),
    ("gpt_neox.final_layer_norm.bias", "norm.final"),
    ("transformer.ln_f.weight", "norm.final"),
    ("transformer.ln_f.bias", "norm.final"),
    ("token_embd.weight", "embed"),
    ("output.weight", "lm_head"),
    ("output_norm.weight", "norm.final"),
    ("output_norm.bias", "norm.final"),
]
ATTENTION = ["attn.q", "attn.k", "attn.v", "attn.o", "attn.qkv"]
FEED_FORWARD = ["mlp.gate", "mlp.up", "mlp.down", "mlp.gate_up", "mlp.fc1", "mlp.fc2"]
NORMS = ["norm.in", "norm.post", "norm.pre_ff", "norm.post_ff", "norm.q", "norm.k"]
#: Roles whose sample is kept by position.
POSITIONAL = [*ATTENTION, "mlp.down", "mlp.fc2"]

#: Family by a pattern found anywhere in the model's id, in any case (fixed values); the first that fits counts.
FAMILIES = [
    (r"meta-llama/Meta-Llama-3\.?1|meta-llama/Llama-3\.1", "llama-3.1"),
    (r"meta-llama/Llama-3\.2", "llama-3.2"),
    (r"meta-llama/Llama-3\.3", "llama-3.3"),
    (r"meta-llama/Meta-Llama-3|meta-llama/Llama-3-", "llama-3"),
    (r"meta-llama/Llama-2", "llama-2"),
    (r"Qwen/Qwen3", "qwen3"),
    (r"Qwen/Qwen2\.5", "qwen2.5"),
    (r"Qwen/Qwen2", "qwen2"),
    (r"Qwen/Qwen1\.5", "qwen1.5"),
    (r"mistralai/Mixtral", "mixtral"),
    (r"mistralai/Mistral", "mistral"),
    (r"google/gemma-3", "gemma-3"),
    (r"google/gemma-2", "gemma-2"),
    (r"google/gemma", "gemma"),
    (r"microsoft/phi-4", "phi-4"),
    (r"microsoft/phi-3", "phi-3"),
    (r"microsoft/phi-2", "phi-2"),
    (r"deepseek-ai/DeepSeek-V3", "deepseek-v3"),
    (r"deepseek-ai/DeepSeek-V2", "deepseek-v2"),
    (r"deepseek-ai/DeepSeek-R1", "deepseek-r1"),
    (r"deepseek-ai/deepseek-llm", "deepseek-llm"),
    (r"zai-org/GLM|THUDM/glm|THUDM/chatglm", "glm"),
    (r"01-ai/Yi", "yi"),
    (r"internlm/internlm2", "internlm2"),
    (r"tiiuae/falcon", "falcon"),
    (r"allenai/OLMo-2", "olmo-2"),
    (r"allenai/OLMo", "olmo"),
    (r"EleutherAI/pythia", "pythia"),
    (r"openlm-research/open_llama", "openllama"),
    (r"stabilityai/stablelm", "stablelm"),
    (r"HuggingFaceTB/SmolLM2", "smollm2"),
    (r"HuggingFaceTB/SmolLM", "smollm"),
    (r"TinyLlama/", "tinyllama"),
    (r"openbmb/MiniCPM", "minicpm"),
]
#: Display group by the prefix of a family (fixed values).
GROUPS = [("llama", "Llama"), ("codellama", "Llama"), ("qwen", "Qwen"), ("mistral", "Mistral"), ("gemma", "Gemma"), ("phi", "Phi"), ("deepseek", "DeepSeek"), ("pythia", "Pythia")]
#: Models that a reference store is seeded with (fixed values).
SEEDS = """
meta-llama/Llama-2-7b-hf meta-llama/Llama-2-13b-hf meta-llama/Meta-Llama-3-8B meta-llama/Meta-Llama-3-8B-Instruct meta-llama/Llama-3.1-8B
meta-llama/Llama-3.1-8B-Instruct meta-llama/Llama-3.2-1B meta-llama/Llama-3.2-3B
Qwen/Qwen1.5-7B Qwen/Qwen2-7B Qwen/Qwen2.5-7B Qwen/Qwen2.5-7B-Instruct Qwen/Qwen2.5-14B Qwen/Qwen2.5-14B-Instruct Qwen/Qwen2.5-Coder-7B Qwen/Qwen3-8B
mistralai/Mistral-7B-v0.1 mistralai/Mistral-7B-v0.3 mistralai/Mistral-7B-Instruct-v0.3
google/gemma-2b google/gemma-7b google/gemma-2-9b google/gemma-3-4b-pt
microsoft/phi-2 microsoft/Phi-3-mini-4k-instruct microsoft/phi-4
deepseek-ai/deepseek-llm-7b-base deepseek-ai/DeepSeek-R1-Distill-Qwen-7B deepseek-ai/DeepSeek-R1-Distill-Llama-8B
01-ai/Yi-6B internlm/internlm2-7b tiiuae/falcon-7b allenai/OLMo-2-1124-7B stabilityai/stablelm-2-1_6b HuggingFaceTB/SmolLM2-1.7B
TinyLlama/TinyLlama-1.1B-Chat-v1.0 openbmb/MiniCPM-2B-sft-bf16
openlm-research/open_llama_7b EleutherAI/pythia-1.4b EleutherAI/pythia-1.4b-deduped EleutherAI/pythia-6.9b
""".split()
#: Quantisation tags from the finest to the coarsest (fixed values).
QUANT_TAGS = (
    "f32 bf16 f16 q8_0 q6_k q5_k_m q5_k_s q5_1 q5_0 q4_k_m q4_k_s iq4_xs iq4_nl q4_1 q4_0 q3_k_l q3_k_m q3_k_s iq3_m iq3_s iq3_xxs "
    "q2_k iq2_m iq2_s iq2_xs iq2_xxs iq1_m iq1_s"
).split()


def first_of(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """CASE with the pairs (condition, value) in order."""
    out = otherwise
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def canonical(name) -> Column:
    """Struct (layer, role): the place of a tensor; layer null outside the layers, role null if unknown."""
    name = F.col(name) if isinstance(name, str) else name
    layer = F.regexp_extract(name, r"^[a-z_.]*?\.(\d+)\.", 1)
    shape = F.regexp_replace(name, r"^([a-z_.]*?\.)\d+\.", "$1#.")
    stem, kind = F.regexp_extract(shape, r"^(.*)\.(weight|bias)$", 1), F.regexp_extract(shape, r"\.(weight|bias)$", 1)
    inside = F.element_at(F.create_map(*[F.lit(x) for p in dict(LAYER_ROLES).items() for x in p]), stem)
    outside = F.element_at(F.create_map(*[F.lit(x) for p in GLOBAL_ROLES for x in p]), name)
    role = F.when(kind == "bias", F.concat(inside, F.lit(".bias"))).otherwise(inside)
    return F.struct(F.when(inside.isNotNull(), F.try_to_number(layer, F.lit("999999")).cast("int")).alias("layer"), F.coalesce(role, outside).alias("role"))


def guess_family(model_id) -> Column:
    model_id = F.col(model_id) if isinstance(model_id, str) else model_id
    return first_of([(model_id.rlike(f"(?i)({p})"), F.lit(f)) for p, f in FAMILIES], F.lower(F.split_part(model_id, F.lit("/"), F.lit(1))))


def group_of(family) -> Column:
    family = F.col(family) if isinstance(family, str) else family
    return first_of([(family.startswith(p), F.lit(g)) for p, g in GROUPS], F.lit("Other"))


def safe_name(model_id) -> Column:
    """A model's id as a file name."""
    model_id = F.col(model_id) if isinstance(model_id, str) else model_id
    return F.replace(F.replace(F.replace(model_id, F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), F.lit(":"), F.lit("_"))


def quant_rank(name) -> Column:
    """Place of the first tag, from the finest, that a file name holds; their number if it holds none."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return first_of([(low.contains(t), F.lit(i)) for i, t in enumerate(QUANT_TAGS)], F.lit(len(QUANT_TAGS)))
