"""Queries: settings of generated pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import generation
from ..sources.views import read, text_table
from .registry import query


def settings_rows(spark, sf):
    """Conversations as prompts of several tools: settings text, JSON of three families, metadata text."""
    c = text_table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    flat = F.translate("text", "\n\"\\:", "    ")
    seed = F.col("id").cast("string")
    a = F.concat(flat, F.lit(" <lora:ink:0.6>\nNegative prompt: lowres, "), "role", F.lit("\nSteps: 28, Sampler: DPM++ 2M, Schedule type: Karras, CFG scale: 6.5, Seed: "), seed,
                 F.lit(", Size: 832x1216, Model hash: abc123, Model: dream_"), "role", F.lit(", Lora hashes: \"detail: 1a2b, ink: 9\", Version: v1.10"))
    j = F.to_json(F.struct(flat.alias("prompt"), F.lit("blurry").alias("negative_prompt"), F.lit("base.bin").alias("base_model"), F.col("id").alias("seed"), F.lit(30).alias("steps"), F.lit(4.5).alias("guidance_scale")))
    s = F.to_json(F.struct(F.struct(flat.alias("prompt"), F.lit("sui").alias("model"), F.lit("20").alias("steps"), F.lit(512).alias("width"), F.lit(768).alias("height")).alias("sui_image_params")))
    inv = F.to_json(F.struct(flat.alias("positive_prompt"), F.lit("bad").alias("negative_prompt"), F.struct(F.lit("inv").alias("name")).alias("model"), F.lit(12).alias("steps"), F.lit(64).alias("width"), F.lit(32).alias("height")))
    m = F.col("id") % 6
    chunks = F.when(m == 0, F.create_map(F.lit("parameters"), a)).when(m == 1, F.create_map(F.lit("parameters"), j)).when(m == 2, F.create_map(F.lit("parameters"), s)).when(
        m == 3, F.create_map(F.lit("invokeai_metadata"), inv)).otherwise(F.create_map(F.lit("Software"), F.lit("other")))
    entry = lambda v: F.struct(F.lit("Ascii").alias("t"), F.array(v).alias("v"))
    meta = F.when(m == 4, F.create_map(F.lit("Exif.Photo.UserComment"), entry(F.concat(F.lit("charset=Unicode "), a)))).when(
        m == 5, F.create_map(F.lit("Xmp.dc.description"), entry(F.concat(F.lit('lang="x-default" '), flat, F.lit(" --ar 16:9 Job ID: 12-ab")))))
    g = graphs(spark, sf).withColumnRenamed("graph", "_g").select("id", "_g")
    c = c.withColumn("chunks", chunks).withColumn("meta", meta).join(g, "id")
    # some rows hold a graph too: in a text chunk (first of all), in a camera field (after the chunks), or one that tells nothing
    found = F.map_concat("chunks", F.create_map(F.lit("prompt"), F.when(F.col("id") % 7 == 0, F.col("_g")).otherwise('{"1": {"class_type": "Note", "inputs": {}}}')))
    camera = F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,struct<t:string,v:array<string>>>")), F.create_map(F.lit("Exif.Image.Model"), entry(F.concat(F.lit("prompt:"), "_g"))))
    return c.withColumn("chunks", F.when(F.col("id") % 7 < 2, found).otherwise(F.col("chunks"))).withColumn("meta", F.when(F.col("id") % 7 == 3, camera).otherwise(F.col("meta"))).drop("_g")


GRAPH_TEXT = r"""trim(translate(trim(text),chr(10)||'"\','   '))"""


@query("extract_generation", oracle=rf"""
WITH c AS (SELECT conv_id*1000+turn AS id, trim(translate(text, chr(10)||'"\:', '    ')) AS flat, translate(text, chr(10)||'"\:', '    ') AS rawp, role, {GRAPH_TEXT} AS g FROM conversations),
t AS (SELECT *, CASE WHEN id%7=0 OR id%7=3 AND id%6>=4 THEN 6 ELSE id%6 END AS m FROM c)
SELECT id, CASE WHEN m=6 THEN 'ComfyUI' WHEN m IN (0,4) THEN 'A1111' WHEN m=1 THEN 'Fooocus' WHEN m=2 THEN 'SwarmUI' WHEN m=3 THEN 'InvokeAI' ELSE 'Midjourney' END AS tool,
 md5(CASE WHEN m=6 THEN CASE WHEN contains(g,'ink '||role) THEN g ELSE g||chr(10)||'ink '||role END WHEN m IN (0,4) THEN ltrim(rawp)||' <lora:ink:0.6>' WHEN m=5 THEN trim(rawp||' --ar 16:9') ELSE rawp END) AS prompt,
 CASE WHEN m IN (0,4) THEN 'lowres, '||role WHEN m=1 THEN 'blurry' WHEN m=3 THEN 'bad' END AS negative, CASE WHEN m=6 THEN role||'.bin' WHEN m IN (0,4) THEN 'dream_'||role WHEN m=1 THEN 'base.bin' WHEN m=2 THEN 'sui' WHEN m=3 THEN 'inv' END AS model,
 CASE WHEN m IN (0,1,4,6) THEN id::varchar END AS seed, CASE WHEN m=6 THEN 20 WHEN m IN (0,4) THEN 28 WHEN m=1 THEN 30 WHEN m=2 THEN 20 WHEN m=3 THEN 12 END::bigint AS steps, CASE WHEN m=6 THEN 3.5 WHEN m IN (0,4) THEN 6.5 WHEN m=1 THEN 4.5 END::double AS cfg,
 CASE WHEN m=6 THEN '1024x768' WHEN m IN (0,4) THEN '832x1216' WHEN m=2 THEN '512x768' WHEN m=3 THEN '64x32' END AS size, CASE WHEN m=6 THEN 'ink.bin=0.7' WHEN m IN (0,4) THEN 'detail=1.0|ink=1.0' END AS loras FROM t""")
def extract_generation(spark, sf):
    g = generation.extract_generation(settings_rows(spark, sf), "chunks", "meta").select("id", "gen").where("gen is not null")
    loras = F.array_join(F.transform("gen.loras", lambda x: F.concat(x["name"], F.lit("="), x["strength"].cast("string"))), "|")
    return g.select("id", "gen.tool", F.md5("gen.prompt").alias("prompt"), "gen.negative", "gen.model", "gen.seed", "gen.steps", "gen.cfg", "gen.size", loras.alias("loras"))


def graphs(spark, sf):
    """A node graph per conversation turn: text reached through a concatenation and, for some, a pass-through node."""
    c = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.translate(F.trim("text"), "\n\"\\", "   ").alias("t"), "role")
    node = lambda cls, **kw: F.struct(F.lit(cls).alias("class_type"), F.struct(*[v.alias(k) for k, v in kw.items()]).alias("inputs"))
    link = lambda n, slot=0: F.from_json(F.lit(f'["{n}","{slot}"]'), "array<string>")
    through = F.col("id") % 3 == 0
    g = F.to_json(F.struct(
        node("KSampler", seed=link("9"), steps=link("13"), cfg=F.lit(3.5), scheduler=link("15"), sampler_name=F.lit("euler"), positive=F.when(through, link("12")).otherwise(link("6")), negative=link("7")).alias("3"),
        node("CheckpointLoaderSimple", ckpt_name=F.concat(F.lit("models/"), "role", F.lit(".bin"))).alias("4"),
        node("LoraLoader", lora_name=F.lit("style/ink.bin"), strength_model=F.lit(0.7)).alias("5"),
        node("CLIPTextEncode", text=link("10"), clip=link("5", 1)).alias("6"),
        node("ConditioningZeroOut", conditioning=link("6")).alias("7"),
        node("EmptyLatentImage", width=F.lit(1024), height=F.lit(768)).alias("8"),
        node("SeedNode", seed=F.col("id")).alias("9"),
        node("StringConcatenate", string_a=F.col("t"), string_b=link("11"), delimiter=F.lit(", ")).alias("10"),
        node("PrimitiveString", value=F.concat(F.lit("ink "), "role")).alias("11"),
        node("ControlNetApply", conditioning=link("6"), strength=F.lit(1)).alias("12"),
        node("Reroute", value=link("14")).alias("13"), node("PrimitiveInt", value=F.lit(20)).alias("14"), node("PrimitiveString", string=F.lit("karras")).alias("15")))
    # the slot of a link is a number
    return c.withColumn("graph", F.regexp_replace(g, r'\["([0-9]+)","([0-9]+)"\]', '["$1",$2]'))


@query("trace_prompt_graph", oracle=r"""
SELECT conv_id*1000+turn AS id, CASE WHEN contains(trim(translate(trim(text),chr(10)||'"\','   ')), 'ink '||role) THEN trim(translate(trim(text),chr(10)||'"\','   ')) ELSE trim(translate(trim(text),chr(10)||'"\','   '))||chr(10)||'ink '||role END AS prompt, NULL::varchar AS negative FROM conversations""")
def trace_prompt_graph(spark, sf):
    return generation.trace_prompt_graph(graphs(spark, sf))


@query("graph_settings", oracle="""
SELECT conv_id*1000+turn AS id, role||'.bin' AS model, '1024x768' AS size, 20::bigint AS steps, 3.5::double AS cfg, (conv_id*1000+turn)::varchar AS seed, 'euler' AS sampler, 'karras' AS scheduler, 'ink.bin=0.7' AS loras FROM conversations""")
def graph_settings(spark, sf):
    s = generation.graph_settings(graphs(spark, sf))
    return s.select("id", "model", "size", "steps", "cfg", "seed", "sampler", "scheduler", F.array_join(F.transform("loras", lambda x: F.concat(x["name"], F.lit("="), x["strength"].cast("string"))), "|").alias("loras"))


@query("short_wide_phrases", oracle="""
SELECT conv_id, turn, CASE WHEN turn%2=0 THEN '海边的女孩|戴着草帽|微笑' ELSE '' END AS phrases FROM conversations""")
def short_wide_phrases(spark, sf):
    c = read(spark, sf, "conversations")
    text = F.concat(F.when(F.col("turn") % 2 == 0, "海边的女孩，戴着草帽、微笑 a 海 "), F.regexp_replace("text", "[^ -~]", ""))
    return c.select("conv_id", "turn", F.coalesce(F.array_join(prompts.short_wide_phrases(text), "|"), F.lit("")).alias("phrases"))
