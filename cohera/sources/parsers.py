"""Readers of outside formats: each gives the bundle's tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohera.operators import patterns
from cohera.operators.components import connected_components

COBRA = """reactions array<struct<id:string,name:string,subsystem:string,lower_bound:double,upper_bound:double,gene_reaction_rule:string,metabolites:map<string,double>,annotation:map<string,array<string>>>>,
metabolites array<struct<id:string,name:string,formula:string,charge:int,compartment:string,annotation:map<string,array<string>>>>,
genes array<struct<id:string,name:string,annotation:map<string,array<string>>>>"""
PAPER = """metadata struct<title:string,note:string,authors:string,arxiv_id:string,journal:string,version:string,papers:array<struct<id:string,title:string,authors:string,journal:string,year:int>>>,
entries array<struct<id:string,title:string,entry_type:string,paper:string,section:string,description:string>>, links array<struct<source:string,target:string,type:string>>"""
OLD_PAPER = """meta struct<package_name:string,name:string>,
entries array<struct<id:string,title:string,entry_type:string,source_type:string,domain:string,status:string,confidence:string,sections:map<string,string>>>,
links array<struct<source:string,target:string,link_type:string,type:string,description:string>>"""
ELEMENTS = "elements array<struct<symbol:string,name:string,number:int,category:string,block:string,period:int,`group`:int,phase:string,summary:string,atomic_mass:double,electronegativity_pauling:double,density:double,melt:double,boil:double,ionization_energies:array<double>,electron_affinity:double,molar_heat:double>>"

# Domains and states of a paper cluster's entry types.
CLUSTER_DOMAIN = {"method": "cosmology", "measurement": "cosmology", "mechanism": "general_relativity", "claim": "cosmology", "reference_law": "general_relativity"}
CLUSTER_STATUS = {"method": "established", "measurement": "established", "mechanism": "established", "claim": "proposed", "reference_law": "established"}
# The same for a single paper, and its claims that still stand.
PAPER_DOMAIN = {"method": "experimental_physics", "measurement": "experimental_physics", "mechanism": "experimental_physics", "claim": "experimental_physics", "reference_law": "theoretical_physics"}
ACTIVE_CLAIMS = ("corrected_result_2012", "conclusions")
# Link types of tier 1.5 in the older paper format.
OLD_STRONG = ("consistent_with", "requires", "enforces", "implies", "agrees_with", "contradicts", "refutes")
# Prefixes, entry types, states and confidences of the complexity classes' four files.
ZOO_PREFIX = {"classes": "cls", "theorems": "thm", "conjectures": "conj", "problems": "prob"}
ZOO_TYPE = {"classes": "reference_law", "theorems": "theorem", "conjectures": "open_question", "problems": "reference_law"}
ZOO_STATUS = {"classes": "established", "theorems": "established", "conjectures": "open", "problems": "established"}
ZOO_CONFIDENCE = {"classes": "Tier 1", "theorems": "Tier 1", "conjectures": "Tier 3", "problems": "Tier 1"}
# Link type and tier by field.
ZOO_LINK = {"related": ("analogous to", "1.5"), "impliedby": ("derives from", "1"), "implies": ("predicts for", "1.5"), "not_implies": ("tensions with", "1.5")}
# Bus types.
BUS_TYPE = {"sl": "slack", "pv": "generator", "pq": "load"}


def _map(values: dict, c: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c], F.lit(default) if isinstance(default, str) else default)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _each(df: DataFrame, field: str) -> DataFrame:
    return df.select(F.explode(field).alias("x")).select("x.*")


def _link(df: DataFrame, kind, source, target, tier, coef=None, text=None) -> DataFrame:
    return df.select(kind.alias("link_type"), source.alias("source_id"), source.alias("source_label"), target.alias("target_id"), target.alias("target_label"),
                     (F.lit(None) if text is None else text).cast("string").alias("description"), tier.cast("string").alias("confidence_tier"), (F.lit(None) if coef is None else coef).cast("double").alias("stoichiometry_coef"))


def _entry(df: DataFrame, i, title, kind, source, domain, status="established", confidence="Tier 2") -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(i.alias("id"), title.alias("title"), lit(kind).alias("entry_type"), lit(source).alias("source_type"), lit(domain).alias("domain"), lit(status).alias("status"), lit(confidence).alias("confidence"))


def _sections(df: DataFrame, i: Column, named: list[tuple[str, Column, int]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("section_name"), c.alias("content"), F.lit(o).alias("section_order")) for n, c, o in named])
    return df.select(i.alias("entry_id"), F.explode(rows).alias("s")).select("entry_id", "s.*").filter(F.coalesce("content", F.lit("")) != "")


def _properties(df: DataFrame, i: Column, named: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("property_name"), c.cast("string").alias("property_value")) for n, c in named.items()])
    return df.select(i.alias("entry_id"), F.explode(rows).alias("p")).select("entry_id", "p.*").filter(F.coalesce("property_value", F.lit("")) != "")


def _listed(annotation: str, keys: list[str], none: str) -> Column:
    lines = [F.when(F.size(F.col(annotation)[k]) > 0, F.concat(F.lit(f"{k}: "), F.array_join(F.col(annotation)[k], ", "))) for k in keys]
    text = F.concat_ws("\n", *lines)
    return F.when(text == "", none).otherwise(text)


def stoichiometry(metabolites: Column, lower: Column) -> Column:
    """'2 a + b -> c': sides by id, coefficients without decimals and 1 left out, <-> if the lower bound is negative."""

    def side(sign: int) -> Column:
        own = F.array_sort(F.filter(F.map_entries(metabolites), lambda e: e["value"] * sign > 0))
        return F.array_join(F.transform(own, lambda e: F.when(F.abs(e["value"]) == 1, e["key"]).otherwise(F.concat(F.format_string("%.0f ", F.abs(e["value"])), e["key"]))), " + ")

    return F.concat_ws(" ", side(-1), F.when(lower < 0, "<->").otherwise("->"), side(1))


def parse_cobra(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A metabolic model: reactions, metabolites and genes with their links."""
    data = _json(spark, path, COBRA)
    rxn, met, gene = (_each(data, f) for f in ("reactions", "metabolites", "genes"))
    rid, mid, gid = (F.concat(F.lit(p), "id") for p in ("rxn_", "met_", "gene_"))
    kind = F.when(F.col("id").startswith("EX_"), "exchange_reaction").otherwise("reaction")
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("id"))
    entries = _entry(rxn, rid, name, "instantiation", kind, "biology").unionByName(_entry(met, mid, name, "instantiation", "metabolite", "chemistry")).unionByName(_entry(gene, gid, name, "instantiation", "gene", "biology"))
    st = rxn.select(rid.alias("r"), F.col("id").alias("raw"), F.explode("metabolites").alias("m", "coef")).filter("coef <> 0")
    how = F.when(F.col("coef") < 0, "consumes").otherwise("produces")
    text = F.concat("raw", F.lit(" "), how, F.lit(" "), "m", F.format_string(" (coef=%+.1f)", F.col("coef")))
    links = _link(st, how, F.col("r"), F.concat(F.lit("met_"), "m"), F.lit("1"), F.abs("coef"), text)
    gr = rxn.select(rid.alias("r"), F.explode(F.array_distinct(F.regexp_extract_all("gene_reaction_rule", F.lit(r"\b[a-z]\d{4}\b"), F.lit(0)))).alias("g"))
    gr = gr.join(gene.select(F.col("id").alias("g")), "g", "left_semi")
    links = links.unionByName(_link(gr, F.lit("catalyzed_by"), F.col("r"), F.concat(F.lit("gene_"), "g"), F.lit("1")))
    base = met.filter(F.col("id").rlike("_[ce]$")).groupBy(F.regexp_replace("id", "_[ce]$", "").alias("b")).agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") == 2)
    at = lambda k: F.concat(F.lit("met_"), F.col("ids")[k])
    links = links.unionByName(_link(base, F.lit("same_metabolite"), at(0), at(1), F.lit("1.5")))
    bounds = F.format_string("Reversible: %s\nFlux bounds: [%s, %s] mmol/gDW/h", F.when(F.col("lower_bound") < 0, "Yes").otherwise("No"), F.col("lower_bound").cast("string"), F.col("upper_bound").cast("string"))
    rule = F.trim(F.coalesce("gene_reaction_rule", F.lit("")))
    what = F.concat(name, F.lit(" is a metabolic reaction in the "), F.coalesce("subsystem", F.lit("unknown")), F.lit(" pathway; "), F.when(F.col("lower_bound") < 0, "reversible.").otherwise("irreversible (forward only)."))
    sections = _sections(rxn, rid, [
        ("What It Captures", what, 1), ("Stoichiometry", stoichiometry(F.col("metabolites"), F.col("lower_bound")), 2), ("Kinetics", bounds, 3),
        ("Gene Associations", F.when(rule == "", "No gene association (spontaneous or unassigned).").otherwise(F.concat(F.lit("Gene-reaction rule: "), rule)), 4),
        ("Annotations", _listed("annotation", ["bigg.reaction", "ec-code", "kegg.reaction", "metanetx.reaction", "rhea", "biocyc"], "No external annotations."), 5),
    ])
    place = F.when(F.col("compartment") == "c", "cytosol").otherwise("extracellular space")
    sections = sections.unionByName(_sections(met, mid, [
        ("What It Captures", F.concat(name, F.lit(" is a metabolite; formula "), F.coalesce("formula", F.lit("unknown")), F.lit(", in the "), place, F.lit(".")), 1),
        ("Chemical Properties", F.concat_ws("\n", F.concat(F.lit("Formula: "), "formula"), F.concat(F.lit("Charge: "), F.format_string("%+d", "charge")), _listed("annotation", ["chebi", "kegg.compound", "inchi_key", "metanetx.chemical"], "No chemical data available.")), 2),
        ("Compartment", F.concat(F.lit("Compartment: "), place, F.lit(" ("), "compartment", F.lit(")")), 3),
    ]))
    sections = sections.unionByName(_sections(gene, gid, [("What It Captures", F.concat(name, F.lit(" (locus tag: "), "id", F.lit(") encodes an enzyme or enzyme subunit.")), 1), ("Annotations", _listed("annotation", ["ncbigene", "uniprot", "refseq_name", "ecogene", "refseq_locus_tag"], "No external annotations."), 2)]))
    props = _properties(rxn, rid, {"subsystem": F.col("subsystem"), "lower_bound": F.col("lower_bound"), "upper_bound": F.col("upper_bound"), "gene_reaction_rule": rule, "ec_code": F.array_join(F.col("annotation")["ec-code"], ", ")})
    props = props.unionByName(_properties(met, mid, {"formula": F.col("formula"), "charge": F.col("charge"), "compartment": F.col("compartment")}))
    return {"entries": entries, "links": links, "sections": sections, "entry_properties": props}


def parse_zoo(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Complexity classes: four JSON files of records. Names resolve to the first file (in order) that has them; names
    that don't become properties; of links between two entries, in either direction, the first stays."""
    schema = "name string, desc string, description string, content string, formal string, notes string, type string, alias string, ref string, properties array<string>, related array<string>, impliedby string, implies array<string>, not_implies array<string>"
    every = None
    for k, source in enumerate(ZOO_PREFIX):
        one = spark.read.schema(schema).json(f"{folder}/{source}.json", multiLine=True).withColumns({"source": F.lit(source), "k": F.struct(F.lit(k), F.monotonically_increasing_id())})
        every = one if every is None else every.unionByName(one)
    i = F.concat(_map(ZOO_PREFIX, F.col("source"), ""), F.lit("_"), F.regexp_replace(F.trim("name"), r"\s+", "_"))
    every = every.withColumn("id", i)
    entries = _entry(every, F.col("id"), F.col("name"), _map(ZOO_TYPE, F.col("source"), ""), F.col("source"), "computer science", _map(ZOO_STATUS, F.col("source"), ""), _map(ZOO_CONFIDENCE, F.col("source"), ""))
    said = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs], F.lit(""))
    claim = said("desc", "description", "content")
    formal = F.coalesce(F.when(F.col("formal") != "", F.col("formal")), F.when(F.col("source").isin("theorems", "conjectures"), F.col("content")))
    sections = _sections(every, F.col("id"), [("What It Claims", claim, 0), ("Mathematical Form", F.when(formal != claim, formal), 1), ("Notes", F.col("notes"), 2)])
    props = _properties(every, F.col("id"), {"class_type": F.col("type"), "alias": F.col("alias"), "reference_url": F.col("ref"), "concept_tags": F.col("name")})
    tags = every.select(F.col("id").alias("entry_id"), F.explode("properties").alias("property_value")).select("entry_id", F.concat(F.lit("class_property_"), "property_value").alias("property_name"), "property_value")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), (F.array(F.col(f)) if f == "impliedby" else F.col(f)).alias("targets"), F.lit(o).alias("o")) for o, f in enumerate(("impliedby", "related", "implies", "not_implies"))])
    asked = every.select("id", "name", "k", F.explode(fields).alias("f")).select("id", "name", "k", "f.field", "f.o", F.posexplode("f.targets").alias("pos", "target")).filter("target is not null")
    names = every.groupBy(F.col("name").alias("target")).agg(F.min_by("id", "k").alias("target_id"))
    j = asked.join(names, "target", "left")
    lost = j.filter("target_id is null").select(F.col("id").alias("entry_id"), F.concat(F.lit("unresolved_"), "field").alias("property_name"), F.col("target").alias("property_value"))
    ok = j.filter("target_id is not null").withColumns({"a": F.least("id", "target_id"), "b": F.greatest("id", "target_id")})
    one = ok.groupBy("a", "b").agg(F.min(F.struct("k", "id", "o", "pos", "field", "target_id")).alias("x"))
    kind = lambda n: _map({f: v[n] for f, v in ZOO_LINK.items()}, F.col("x.field"), "")
    links = _link(one, kind(0), F.col("x.id"), F.col("x.target_id"), kind(1), None, F.col("x.field"))
    props = props.unionByName(tags).unionByName(lost).dropDuplicates(["entry_id", "property_name"])
    return {"entries": entries, "links": links, "sections": sections, "entry_properties": props}


def parse_elements(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A periodic table: elements with their properties and the three families of links."""
    el = _each(_json(spark, path, ELEMENTS), "elements").withColumn("id", F.concat(F.lit("elem_"), "symbol"))
    both = (F.col("number") > 83) | (F.col("category") == "noble gas")
    entries = _entry(el, F.col("id"), F.col("name"), "instantiation", "element", F.when(both, "chemistry · physics").otherwise("chemistry"))
    fmt = lambda f, c: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c)))
    props = _properties(el, F.col("id"), {
        "atomic_number": F.col("number"), "symbol": F.col("symbol"), "category": F.col("category"), "block": F.col("block"), "period": F.col("period"),
        "group": F.col("group"), "phase_at_stp": F.col("phase"), "atomic_mass_u": fmt("%.4f", "atomic_mass"), "electronegativity_pauling": fmt("%.2f", "electronegativity_pauling"),
        "density_g_cm3": fmt("%.4f", "density"), "melting_point_K": fmt("%.3f", "melt"), "boiling_point_K": fmt("%.3f", "boil"),
        "first_ionization_energy_kJ_mol": F.when(F.size("ionization_energies") > 0, F.format_string("%.1f", F.get("ionization_energies", 0))),
        "electron_affinity_kJ_mol": fmt("%.3f", "electron_affinity"), "molar_heat_J_mol_K": fmt("%.3f", "molar_heat"),
    })
    identity = F.concat(F.lit("Symbol: "), "symbol", F.lit("\nAtomic number: "), F.col("number").cast("string"), F.lit("\nCategory: "), F.coalesce("category", F.lit("unknown")))
    sections = _sections(el, F.col("id"), [("What It Captures", F.trim("summary"), 0), ("Identity", identity, 1)])
    return {"entries": entries, "links": patterns.element_links(el), "sections": sections, "entry_properties": props}


def parse_grid(buses: DataFrame, generators: DataFrame, lines: DataFrame, case: str) -> dict[str, DataFrame]:
    """A power grid of buses (idx, type, vn_kv, vm_pu, va_degree), generators (idx, bus, p_mw, q_mvar) and lines
    (from_bus, to_bus): each line gives a link in either direction."""
    up = case.upper()
    bus = lambda c: F.concat(F.lit(f"{up}_B"), F.col(c).cast("string"))
    gen = F.concat(F.lit(f"{up}_G"), F.col("idx").cast("string"))
    kind = _map(BUS_TYPE, F.coalesce(F.col("type"), F.lit("load")), F.coalesce(F.col("type"), F.lit("load")))
    entries = _entry(buses, bus("idx"), F.concat(F.lit("Bus "), F.col("idx").cast("string"), F.lit(" ("), kind, F.lit(")")), "instantiation", "bus", "engineering", "complete")
    entries = entries.unionByName(_entry(generators, gen, F.concat(F.lit("Generator "), F.col("idx").cast("string"), F.lit(" (Bus "), F.col("bus").cast("string"), F.lit(")")), "instantiation", "generator", "engineering", "complete"))
    links = _link(generators, F.lit("supplies_power_to"), gen, bus("bus"), F.lit("1"))
    for a, b in (("from_bus", "to_bus"), ("to_bus", "from_bus")):
        links = links.unionByName(_link(lines, F.lit("transmits_to"), bus(a), bus(b), F.lit("1")))
    props = _properties(buses, bus("idx"), {"voltage_magnitude_pu": F.col("vm_pu"), "voltage_angle_deg": F.col("va_degree"), "nominal_voltage_kv": F.col("vn_kv"), "bus_type": kind})
    sections = _sections(buses, bus("idx"), [("Bus Specification", F.concat(F.lit("Bus Number: "), F.col("idx").cast("string"), F.lit("\nType: "), kind), 0)])
    return {"entries": entries, "links": links, "sections": sections, "entry_properties": props}


def grid_connected(buses: DataFrame, lines: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: buses, buses of the largest component, and whether that is at least 95 %."""
    parts = connected_components(lines.select(F.col("from_bus").alias("u"), F.col("to_bus").alias("v")))
    largest = parts.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("largest")).withColumn("k", F.lit(1))
    total = buses.agg(F.count(F.lit(1)).alias("n_buses")).withColumn("k", F.lit(1))
    return total.join(largest, "k").drop("k").withColumn("connected", F.col("largest") >= least * F.col("n_buses"))


def parse_cluster(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Papers, entries and links of a cluster; links of unknown ids are kept apart as skipped_links."""
    return _paper(spark, path, CLUSTER_DOMAIN, "cosmology", _map(CLUSTER_STATUS, F.col("entry_type"), "established"))


def parse_paper(spark: SparkSession, path: str, active: tuple[str, ...] = ACTIVE_CLAIMS) -> dict[str, DataFrame]:
    """A single paper: its claims are superseded but for the active ones."""
    status = F.when((F.col("entry_type") == "claim") & ~F.col("id").isin(*active), "superseded").when(F.col("entry_type") == "claim", "superseded" if not active else "established").otherwise("established")
    return _paper(spark, path, PAPER_DOMAIN, "experimental_physics", status)


def _paper(spark: SparkSession, path: str, domains: dict, domain: str, status: Column) -> dict[str, DataFrame]:
    data = _json(spark, path, PAPER)
    e = _each(data, "entries")
    entries = _entry(e, F.col("id"), F.col("title"), F.col("entry_type"), "paper_section", _map(domains, F.col("entry_type"), domain), status, "Tier 1")
    sections = _sections(e, F.col("id"), [("Paper Content", F.col("description"), 1), ("Paper Section", F.col("section"), 2)])
    props = _properties(e, F.col("id"), {"source_paper": F.col("paper"), "paper_section": F.col("section"), "entry_type": F.col("entry_type")})
    raw, ids = _each(data, "links"), e.select("id").distinct()
    ok = raw.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    have = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}"))
    skipped = raw.join(have("source"), "source", "left").join(have("target"), "target", "left").filter("has_source is null or has_target is null").select("source", "target", "type")
    papers = data.select(F.explode("metadata.papers").alias("p")).select("p.*")
    return {"entries": entries, "links": _link(ok, F.col("type"), F.col("source"), F.col("target"), F.lit("1")), "sections": sections, "entry_properties": props, "skipped_links": skipped, "papers": papers}


def parse_old_paper(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The older paper format: sections as an object in order; tier 1.5 for some link types, else 2."""
    data = _json(spark, path, OLD_PAPER)
    e = _each(data, "entries")
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    entries = _entry(e, F.col("id"), F.col("title"), F.col("entry_type"), d("source_type", "unknown"), d("domain", "physics"), d("status", "established"), d("confidence", "Tier 2"))
    sections = e.select(F.col("id").alias("entry_id"), F.posexplode("sections").alias("section_order", "section_name", "content")).select("entry_id", "section_name", "content", "section_order")
    raw = _each(data, "links")
    kind = F.coalesce("link_type", "type", F.lit("related_to"))
    links = _link(raw, kind, F.col("source"), F.col("target"), F.when(kind.isin(*OLD_STRONG), "1.5").otherwise("2"), None, F.col("description"))
    return {"entries": entries, "links": links, "sections": sections}


def read_csv_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """entries.csv and links.csv with headers."""
    from cohera.schemas import ENTRIES, LINKS, conform

    raw = lambda n: spark.read.csv(f"{folder}/{n}.csv", header=True)
    return {"entries": conform(raw("entries"), ENTRIES), "links": conform(raw("links"), LINKS)}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) of text files (pages parted by form feeds) and, where PyMuPDF is installed, of PDF files."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                if name.lower().endswith(".pdf"):
                    import fitz

                    texts = [p.get_text(sort=True) for p in fitz.open(stream=bytes(content), filetype="pdf")]
                else:
                    texts = bytes(content).decode("utf-8", "replace").split("\f")
                rows += [(name, k, t) for k, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc string, page int, text string")
