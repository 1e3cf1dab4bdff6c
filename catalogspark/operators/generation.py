"""Settings of generated pictures: typed settings from embedded text, prompts traced through node graphs, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions.text import alower, basename, let
from .ranking import stage

COLUMNS = ["tool", "field", "prompt", "negative", "model", "sampler", "scheduler", "seed", "size", "steps", "cfg", "loras", "sources"]
_LORAS = "array<struct<name:string,strength:double>>"


def _info(tool, **kw) -> Column:
    """One settings struct; missing parts are NULL."""
    types = {"steps": "bigint", "cfg": "double", "loras": _LORAS, "sources": "array<string>"}
    vals = {"tool": tool, "field": F.col("_g.field"), **kw}
    return F.struct(*[(vals[c] if isinstance(vals.get(c), Column) else F.lit(vals.get(c))).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def _json(key: str) -> Column:
    return F.get_json_object(F.col("_g.text"), "$." + key)


def _size(w: Column, h: Column) -> Column:
    return F.concat(w, F.lit("x"), h)


def _sources(chunks: str, meta: str | None) -> Column:
    """The first embedded text that holds settings, as ``struct<kind, field, text>``; the order is the tools' priority."""
    c = lambda k: F.try_element_at(F.col(chunks), F.lit(k))
    src = lambda cond, kind, field, text: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text.alias("text")))

    def json_kinds(text, field):
        g = lambda k: F.get_json_object(text, "$." + k).isNotNull()
        return [src(F.ltrim(text).startswith("{") & g("sui_image_params"), "SwarmUI", field, text), src(F.ltrim(text).startswith("{") & g("prompt"), "JSON", field, text)]

    where, par = "text chunk: parameters", c("parameters")
    options = [*json_kinds(par, where), src((F.trim(par) != "") & ~F.ltrim(par).startswith("{"), "text", where, par),
               src(F.get_json_object(c("invokeai_metadata"), "$").startswith("{"), "InvokeAI", "text chunk: invokeai_metadata", c("invokeai_metadata")),
               src(F.contains(c("Software"), F.lit("NovelAI")) & F.get_json_object(c("Comment"), "$").startswith("{"), "NovelAI", "text chunk: Comment", c("Comment"))]
    if meta is not None:
        m = lambda k: F.get(F.try_element_at(F.col(meta), F.lit(k))["v"], F.lit(0))
        for k in ("Exif.Photo.UserComment", "Exif.Image.ImageDescription", "Xmp.exif.UserComment"):
            v = F.trim(F.regexp_replace(m(k), "^charset=[^ ]* ?", ""))
            options += [src(v.rlike(r"(?s)^Steps: |\nSteps: |Negative prompt:"), "text", k, v), *json_kinds(v, k)]
        for k in ("Xmp.dc.description", "Exif.Image.ImageDescription", "Xmp.iptc.Description"):
            v = F.regexp_replace(m(k), "^lang=[^ ]* ?", "")
            options.append(src(F.contains(v, F.lit("Job ID:")), "Midjourney", k, F.trim(F.split_part(v, F.lit("Job ID:"), F.lit(1)))))
    return F.coalesce(*options)


def graph_text(chunks: str, meta: str | None) -> Column:
    """A node graph that comes before (text chunk) or after (camera fields) the other text chunks, as ``struct<field, text, first>``."""
    c = F.try_element_at(F.col(chunks), F.lit("prompt"))
    pick = lambda cond, field, text, first: F.when(cond, F.struct(F.lit(field).alias("field"), text.alias("text"), F.lit(first).alias("first")))
    options = [pick(c.isNotNull(), "text chunk: prompt", c, True)]
    for k in ("Exif.Image.Model", "Exif.Image.Make") if meta is not None else ():
        v = F.get(F.try_element_at(F.col(meta), F.lit(k))["v"], F.lit(0))
        options.append(pick(v.startswith("prompt:"), k, F.substring(v, F.lit(8), F.length(v)), False))
    return F.coalesce(*options)


def extract_generation(df: DataFrame, chunks: str = "chunks", meta: str | None = None, id_: str = "id") -> DataFrame:
    """Add ``gen``: typed settings from a node graph, from text chunks (``map<string,string>``), else from metadata text.

    The source is chosen first and parsed once. Only rows with a graph are traced; a graph that tells neither text nor model leaves the
    choice to the other sources.
    """
    graphs = df.select(id_, graph_text(chunks, meta).alias("_t")).where("_t is not null").select(id_, F.col("_t.text").alias("graph"), F.col("_t.field").alias("_field"), F.col("_t.first").alias("_first"))
    info = graph_info(graphs, "graph", id_).where((F.coalesce("prompt", F.lit("")) != "") | (F.coalesce("model", F.lit("")) != "")).join(graphs.select(id_, "_field", "_first"), id_)
    types = {"steps": "bigint", "cfg": "double", "loras": _LORAS, "sources": "array<string>"}
    value = {"tool": F.lit("ComfyUI"), "field": F.col("_field")}
    traced = info.select(id_, F.struct(*[value.get(k, F.col(k) if k not in value else None).cast(types.get(k, "string")).alias(k) for k in COLUMNS]).alias("_graph"), "_first")
    texts = _text_settings(df, chunks, meta)
    chunk_gen = F.when(F.coalesce(F.col("gen.field").startswith("text chunk:"), F.lit(False)), F.col("gen"))
    out = texts.join(traced, id_, "left")
    # a graph in a text chunk comes first, one in a camera field after the other text chunks
    return out.withColumn("gen", F.coalesce(F.when(F.col("_first"), F.col("_graph")), chunk_gen, F.col("_graph"), F.col("gen"))).drop("_graph", "_first")


def _text_settings(df: DataFrame, chunks: str, meta: str | None) -> DataFrame:
    d = stage(df.withColumn("_g", _sources(chunks, meta)), "settings")
    d = d.withColumn("_p", F.when(F.col("_g.kind") == "text", pr.settings_parts("_g.text"))).withColumn("_kv", pr.settings_pairs("_p.params"))
    v = lambda k: pr.pair_value("_kv", k)
    s = lambda k: _json("sui_image_params." + k)
    tool = F.when(pr.any_of([_json(k).isNotNull() for k in ("base_model", "fooocus_scheme", "styles")]), "Fooocus").otherwise("JSON")
    c = lambda k: F.try_element_at(F.col(chunks), F.lit(k))
    kinds = {
        "text": _info("A1111", prompt=F.col("_p.prompt"), negative=F.col("_p.negative"), model=F.coalesce(v("Model"), v("Model hash")), sampler=v("Sampler"), scheduler=v("Schedule type"),
                      seed=v("Seed"), size=v("Size"), steps=pr.leading_int(v("Steps")), cfg=pr.leading_number(v("CFG scale")), loras=pr.lora_tags("_p.prompt", v("Lora hashes"))),
        "SwarmUI": _info("SwarmUI", prompt=s("prompt"), negative=s("negativeprompt"), model=s("model"), sampler=s("sampler"), scheduler=s("scheduler"), seed=s("seed"),
                         size=_size(s("width"), s("height")), steps=pr.leading_int(s("steps")), cfg=pr.leading_number(s("cfgscale"))),
        "JSON": _info(tool, prompt=_json("prompt"), negative=_json("negative_prompt"), model=pr.first_set(_json("base_model"), _json("model")), sampler=_json("sampler"),
                      scheduler=_json("scheduler"), seed=_json("seed"), size=_json("resolution"), steps=pr.leading_int(_json("steps")), cfg=pr.leading_number(_json("guidance_scale"))),
        "InvokeAI": _info("InvokeAI", prompt=_json("positive_prompt"), negative=_json("negative_prompt"), model=_json("model.name"), seed=_json("seed"), scheduler=_json("scheduler"),
                          steps=pr.leading_int(_json("steps")), cfg=pr.leading_number(_json("cfg_scale")), size=_size(_json("width"), _json("height"))),
        "NovelAI": _info("NovelAI", prompt=F.coalesce(_json("prompt"), c("Description")), negative=_json("uc"), model=c("Source"), sampler=_json("sampler"), seed=_json("seed"),
                         steps=pr.leading_int(_json("steps")), cfg=pr.leading_number(_json("scale"))),
        "Midjourney": _info("Midjourney", prompt=F.col("_g.text")),
    }
    return d.withColumn("gen", F.coalesce(*[F.when(F.col("_g.kind") == k, info) for k, info in kinds.items()])).drop("_g", "_p", "_kv")


# ---- node graphs

LINK = r'^\s*\[\s*"?([^",\[\]]+)"?\s*,\s*(-?\d+)\s*\]\s*$'
# fixed values: input names that hold text, and how deep links are followed
TEXTISH = "text|prompt|string|value|positive|negative|t5xxl|clip_l|clip_g|caption|wildcard"
MAX_DEPTH = 14


GRAPH = "map<string,struct<class_type:string,inputs:map<string,string>>>"
# one step of the walk: what the frontier's nodes hold becomes texts, and the links to follow next
_STEP = """
named_struct(
  'frontier', transform(array(array_sort(flatten(transform(flatten(transform(s.frontier, f -> transform(
      filter(coalesce(_nodes[f.node].inputs, array()), i -> i.link is not null), i -> named_struct('f', f, 'i', i, 'text', i.textish and (not _nodes[f.node].both or i.neg = (f.role = 1)))))),
    x -> case
      when x.text then array(named_struct('start', x.f.start, 'role', if(x.i.neg, 1, x.f.role), 'node', x.i.link, 'path', concat(x.f.path, array(named_struct('pos', x.i.pos, 'through', false)))))
      when x.i.cond and not (x.i.key = 'positive' and x.f.role = 1) and not (x.i.key = 'negative' and x.f.role = 0)
        then array(named_struct('start', x.f.start, 'role', x.f.role, 'node', x.i.link, 'path', concat(x.f.path, array(named_struct('pos', x.i.pos, 'through', true)))))
      else array() end)))),
    l -> filter(l, (x, k) -> k = 0 or not (l[k - 1].start = x.start and l[k - 1].role = x.role and l[k - 1].node = x.node)))[0],
  'texts', concat(s.texts, flatten(transform(s.frontier, f -> transform(
      filter(coalesce(_nodes[f.node].inputs, array()), i -> i.link is null and i.textish and (not _nodes[f.node].both or i.neg = (f.role = 1)) and coalesce(trim(i.val), '') <> ''),
      i -> named_struct('start', f.start, 'path', concat(f.path, array(named_struct('pos', i.pos, 'through', false))), 'text', trim(i.val)))))))
"""
_PATH = "array<struct<pos:int,through:boolean>>"
_WALK = f"struct<frontier:array<struct<start:int,role:int,node:string,path:{_PATH}>>,texts:array<struct<start:int,path:{_PATH},text:string>>>"


def _walkable(nodes: Column) -> Column:
    """``map<node, struct<both, inputs>>``: every node's inputs in the order of their names, as texts or links, with their roles."""
    def one(e: Column, pos: Column) -> Column:
        key, val = alower(e["key"]), e["value"]
        neg = F.contains(key, F.lit("negative")) | (key == "uc")
        return F.struct(pos.alias("pos"), key.alias("key"), val.alias("val"), F.when(val.rlike(LINK), F.regexp_extract(val, LINK, 1)).alias("link"), key.rlike(TEXTISH).alias("textish"), neg.alias("neg"),
                        (F.contains(key, F.lit("conditioning")) | key.isin("positive", "negative", "guider")).alias("cond"))

    def node(_: Column, n: Column) -> Column:
        by_name = F.array_sort(F.map_entries(n["inputs"]), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        found = F.when(F.contains(n["class_type"], F.lit("ZeroOut")), F.lit(None)).when(n["class_type"].isNotNull(), F.transform(by_name, one))
        return let(found, lambda i: F.struct((F.exists(i, lambda x: x["textish"] & x["neg"]) & F.exists(i, lambda x: x["textish"] & ~x["neg"])).alias("both"), i.alias("inputs")))

    return F.transform_values(nodes, node)


def _first_links(nodes: str, walk: str) -> Column:
    """The links behind the sampler's positive and negative inputs (the first sampler, else the last guider), or behind its guider's."""
    able = F.filter(F.map_entries(nodes), lambda e: e["value"]["class_type"].rlike("Sampler|Guider") & (F.map_contains_key(e["value"]["inputs"], F.lit("positive")) | F.map_contains_key(e["value"]["inputs"], F.lit("guider"))))
    sampler = lambda e: F.contains(e["value"]["class_type"], F.lit("Sampler"))
    root = F.array_min(F.transform(able, lambda e: F.struct((~sampler(e)).alias("g"), (F.when(sampler(e), 1).otherwise(-1) * e["key"].try_cast("int")).alias("n"), e["key"].alias("node"))))["node"]
    inputs = lambda node: F.coalesce(F.try_element_at(F.col(walk), node)["inputs"], F.array())

    def links(of: Column, *keys: str) -> Column:
        role = lambda i: F.when(i["key"] == "negative", 1).otherwise(0)
        return F.transform(F.filter(of, lambda i: i["key"].isin(*keys) & i["link"].isNotNull()), lambda i: F.struct(role(i).alias("start"), role(i).alias("role"), i["link"].alias("node"), F.array().cast(_PATH).alias("path")))

    def start(own: Column) -> Column:
        guider = F.get(F.filter(own, lambda i: (i["key"] == "guider") & i["link"].isNotNull()), F.lit(0))["link"]
        return let(links(own, "positive", "negative"), lambda d: F.when(F.size(d) > 0, d).otherwise(links(inputs(guider), "positive", "negative", "conditioning")))

    return let(inputs(root), start)


def trace_prompt_graph(df: DataFrame, graph: str = "graph", id_: str = "id", max_depth: int = MAX_DEPTH) -> DataFrame:
    """``id, prompt, negative``: the text behind the sampler's positive and negative inputs.

    Every graph is walked breadth-first inside its own row: a fold over the steps whose state is the frontier and the texts found, so nothing is
    shuffled or written. A path remembers the input positions it took, so the texts can be put back in reading order, and where it only passed
    through a node: such a branch counts when the node's own text inputs led nowhere. A node is followed once per step, role and side.
    """
    d = df.select(id_, F.from_json(F.col(graph), GRAPH).alias("_json")).where("_json is not null")
    # the barriers keep the prepared nodes from being computed again wherever the walk looks one up
    d = stage(d.withColumn("_nodes", _walkable(F.col("_json"))), "nodes")
    d = stage(d.withColumn("_start", _first_links("_json", "_nodes")).drop("_json"), "start")
    state = F.expr(f"aggregate(sequence(0, {int(max_depth)}), cast(named_struct('frontier', _start, 'texts', array()) as {_WALK}), (s, n) -> cast({_STEP} as {_WALK}))")
    d = stage(d.withColumn("_texts", state["texts"]).select(id_, "_texts").where("size(_texts) > 0"), "traced")
    prefix = lambda p, k: F.transform(F.slice(p, F.lit(1), k), lambda s: s["pos"])

    def beaten(ts: Column, t: Column) -> Column:
        """Some step only passed through a node whose text inputs also led to text."""
        return F.exists(F.sequence(F.lit(1), F.size(t["path"])), lambda k: F.get(t["path"], k - 1)["through"] & F.exists(ts, lambda o: (
            (F.size(o["path"]) >= k) & (prefix(o["path"], k - 1) == prefix(t["path"], k - 1)) & ~F.get(o["path"], k - 1)["through"])))

    def side(which: int) -> Column:
        mine = F.array_sort(F.transform(F.filter("_texts", lambda t: t["start"] == which), lambda t: F.struct(t["path"].alias("path"), t["text"].alias("text"))))
        joined = lambda ts: F.aggregate(F.filter(ts, lambda t: ~beaten(ts, t)), F.lit(""), lambda acc, t: F.when(F.contains(acc, t["text"]), acc).when(acc == "", t["text"]).otherwise(F.concat(acc, F.lit("\n"), t["text"])))
        return let(mine, lambda ts: F.when(F.size(ts) > 0, joined(ts)))

    return d.select(id_, side(0).alias("prompt"), side(1).alias("negative"))


def _graph(text: Column) -> Column:
    """The nodes of a graph in order of their numbers, as ``array<struct<key, value<class_type, inputs>>>``; null for other text."""
    nodes = F.map_entries(F.from_json(text, GRAPH))
    number = lambda x: F.coalesce(x["key"].try_cast("int"), F.lit(0))
    return F.array_sort(nodes, lambda a, b: F.when(number(a) < number(b), -1).when(number(a) > number(b), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


LITERAL_KEYS = ("seed", "noise_seed", "value", "int", "float", "number", "string")  # fixed values: where a linked node keeps a literal
LITERAL_DEPTH = 6


def graph_settings(df: DataFrame, graph: str = "graph", id_: str = "id") -> DataFrame:
    """``id, model, size, steps, cfg, seed, sampler, scheduler, loras, sources, fallback`` from the node graph.

    Every graph is walked in its own row. Literals behind links are followed ``LITERAL_DEPTH`` steps; a seed may also come from the noise node of
    the sampler. ``fallback`` is the text of all encoders, for graphs without a sampler that leads to text.
    """
    d = df.select(id_, _graph(F.col(graph)).alias("_a")).withColumn("_m", F.map_from_entries("_a"))
    got = lambda inputs, k: F.try_element_at(inputs, F.lit(k))
    inputs_of = lambda link: F.try_element_at("_m", F.regexp_extract(link, LINK, 1))["inputs"]

    def literal(v: Column) -> Column:
        """A value, or what stands behind a chain of links; null when the chain is too long."""
        step = lambda acc: F.coalesce(*[got(inputs_of(acc), k) for k in LITERAL_KEYS])
        end = F.aggregate(F.sequence(F.lit(1), F.lit(LITERAL_DEPTH + 1)), v, lambda acc, _: F.when(acc.rlike(LINK), step(acc)).otherwise(acc))
        return F.when(~end.rlike(LINK), end)

    def first(cond, value) -> Column:
        """The value of the first node that has one."""
        return F.get(F.filter(F.transform("_a", lambda n: F.when(cond(n), value(n))), lambda v: v.isNotNull() & (v != "")), F.lit(0))

    cls, inp = (lambda n: n["value"]["class_type"]), (lambda n: n["value"]["inputs"])
    always = lambda n: F.lit(True)
    has = lambda n, w: F.coalesce(F.contains(cls(n), F.lit(w)), F.lit(False))
    loader = lambda n: has(n, "Loader") & ~F.coalesce(cls(n).rlike("CLIP|VAE|Lora|LoRA"), F.lit(False))
    unet = lambda n: F.coalesce(F.nullif(got(inp(n), "unet_name"), F.lit("")), F.when(loader(n), got(inp(n), "model_name")))
    number = r"^-?\d+(\.\d+)?$"
    # the literals inside a lambda may refer to the row's columns only, so sizes and strengths are resolved per node
    size = lambda n: F.when(literal(got(inp(n), "width")).rlike(number) & literal(got(inp(n), "height")).rlike(number), F.concat(
        literal(got(inp(n), "width")).cast("double").cast("bigint").cast("string"), F.lit("x"), literal(got(inp(n), "height")).cast("double").cast("bigint").cast("string")))
    strength = lambda n: F.when(got(inp(n), "strength_model").isNotNull(), literal(got(inp(n), "strength_model"))).otherwise(literal(got(inp(n), "strength")))
    loras = F.transform(F.filter("_a", lambda n: F.coalesce(got(inp(n), "lora_name") != "", F.lit(False))), lambda n: F.struct(
        basename(got(inp(n), "lora_name")).alias("name"), F.coalesce(strength(n).try_cast("double"), F.lit(1.0)).alias("strength")))
    images = F.transform(F.filter("_a", lambda n: F.coalesce(cls(n).isin("LoadImage", "LoadImageMask") & (got(inp(n), "image") != ""), F.lit(False))), lambda n: got(inp(n), "image"))
    able = F.filter("_a", lambda n: F.coalesce(F.map_contains_key(inp(n), F.lit("positive")) | F.map_contains_key(inp(n), F.lit("guider")), F.lit(False)) & (has(n, "Sampler") | has(n, "Guider")))
    d = d.withColumn("_able", able)
    d = d.withColumn("_s", F.coalesce(F.get(F.filter("_able", lambda n: has(n, "Sampler")), F.lit(0)), F.try_element_at("_able", F.lit(-1)))["value"]["inputs"])
    lit = lambda k: literal(got(F.col("_s"), k))
    whole = lambda v: F.when(v.rlike(r"^-?\d+$"), v)
    noise = F.when(got(F.col("_s"), "noise").rlike(LINK), literal(got(inputs_of(got(F.col("_s"), "noise")), "noise_seed")))
    texts = lambda n: F.transform(F.filter(F.array_sort(F.map_entries(inp(n)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: (
        alower(e["key"]).rlike(TEXTISH) & ~(F.contains(alower(e["key"]), F.lit("negative")) | (alower(e["key"]) == "uc")) & ~e["value"].rlike(LINK) & (e["value"] != ""))), lambda e: e["value"])
    encoders = F.array_join(F.flatten(F.transform(F.filter("_a", lambda n: has(n, "TextEncode")), texts)), "\n")
    return d.select(
        id_, basename(F.coalesce(first(always, lambda n: got(inp(n), "ckpt_name")), first(always, unet))).alias("model"), first(lambda n: has(n, "LatentImage"), size).alias("size"),
        whole(lit("steps")).cast("bigint").alias("steps"), F.when(lit("cfg").rlike(number), lit("cfg")).cast("double").alias("cfg"),
        F.coalesce(whole(lit("seed")), whole(lit("noise_seed")), whole(noise)).alias("seed"), lit("sampler_name").alias("sampler"), lit("scheduler").alias("scheduler"),
        loras.alias("loras"), images.alias("sources"), F.nullif(encoders, F.lit("")).alias("fallback"))


def graph_info(df: DataFrame, graph: str = "graph", id_: str = "id") -> DataFrame:
    """``id, prompt`` and the other settings of each graph: the traced text, or that of all encoders where no sampler leads to any."""
    s = graph_settings(df, graph, id_).join(trace_prompt_graph(df, graph, id_), id_, "left")
    return s.withColumn("prompt", F.coalesce(F.nullif("prompt", F.lit("")), "fallback")).drop("fallback")


# ---- keywords

MANY_ROWS = 1000


def word_frequency(df: DataFrame, text: str, id_: str = "id", max_n: int = 10) -> DataFrame:
    """``id, word, n, rank``: the most frequent meaningful words of each text, first seen first on ties.

    A text is shuffled once, by its id, and its words are counted and ranked where it arrives: they are several times as large as the text.
    Only the words of an id with very many rows are counted map-side and meet by word, so that no task holds such an id's texts.
    """
    many = df.groupBy(id_).count().where(F.col("count") > MANY_ROWS).select(F.col(id_).alias("_many")).hint("broadcast")
    same = F.col(id_).eqNullSafe(F.col("_many"))

    def counted(rows: DataFrame) -> DataFrame:
        words = rows.select(id_, F.posexplode(pr.prompt_words(text)).alias("p", "word"))
        return words.groupBy(id_, "word").agg(F.count("*").alias("n"), F.min("p").alias("first"))

    w = Window.partitionBy(id_).orderBy(F.desc("n"), "first")
    ranked = lambda rows: counted(rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_n).select(id_, "word", "n", "rank")
    few = df.select(id_, text).join(many, same, "left_anti").repartition(id_)
    return ranked(few).unionByName(ranked(df.select(id_, text).join(many, same, "left_semi")))


def once_per_distinct(df: DataFrame, key: str, compute) -> DataFrame:
    """Run ``compute`` (DataFrame of distinct keys -> same plus results) once per distinct key and join the results back."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(compute(keys), key, "left")
