"""The batch analysis as one call: every fact table written once, read by all that builds on it.

    Pipeline(lines, goods, "hdfs:///facts").run("kpis")

Tables are written to a folder that the driver and all executors reach; a run for a scope writes what
the scope needs and returns its tables by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import documents as B
from tallyforge.operators import sales as S
from tallyforge.operators import templates as T
from tallyforge.operators import texts as P
from tallyforge.sources.files import write_documents, write_index
from tallyforge.sources.stored import shared_folder, stored


class Pipeline:
    """Facts on normalised lines and a catalogue (``sources.roles`` has their columns)."""

    def __init__(self, lines: DataFrame, goods: DataFrame, folder: str | None = None, as_of: str = "2000-01-01"):
        self.goods, self.as_of = goods, as_of
        self.folder = (folder or shared_folder(lines.sparkSession)).rstrip("/")
        self._made: dict[str, DataFrame] = {}
        t = self.table
        self._plans: dict[str, Callable[[], DataFrame]] = {
            "lines": lambda: lines,
            "dataset_quality": lambda: S.dataset_quality(t("lines")),
            "line_gaps": lambda: S.line_gaps(t("lines")),
            "quality_issues": lambda: S.quality_issues(t("lines"), goods),
            "deal_facts": lambda: S.deal_facts(t("lines")),
            "product_facts": lambda: S.product_facts(t("lines"), goods),
            "bundle_facts": lambda: S.bundle_facts(t("deal_facts")),
            "client_facts": lambda: S.client_facts(t("deal_facts")),
            "template_matches": lambda: S.template_matches(t("deal_facts")),
            "timelines": lambda: S.timelines(t("deal_facts")),
            "deal_profiles": lambda: S.deal_profiles(t("lines"), t("deal_facts")),
            "service_composition": lambda: S.service_composition(t("lines"), t("deal_facts")),
            "pricing": lambda: S.pricing(t("product_facts")),
            "monthly_kpis": lambda: S.monthly_kpis(t("deal_facts")),
            "catalogue_use": lambda: S.catalogue_use(t("product_facts")),
            "price_stability": lambda: S.price_stability(t("product_facts")),
            "client_concentration": lambda: S.client_concentration(t("deal_facts")),
            "kpi_summary": lambda: S.kpi_summary(t("product_facts"), t("deal_facts"), t("template_matches")),
            "canonical_deals": lambda: T.canonical_deals(t("deal_facts").withColumn("category", F.col("primary_direction")), "category"),
            "canonical_positions": self._positions,
        }

    SCOPES = {
        "qa": ("dataset_quality", "line_gaps", "quality_issues"),
        "facts": ("deal_facts", "product_facts", "bundle_facts", "client_facts", "template_matches", "timelines", "deal_profiles", "service_composition"),
        "pricing": ("pricing",),
        "kpis": ("monthly_kpis", "catalogue_use", "price_stability", "client_concentration", "kpi_summary"),
        "templates": ("canonical_deals", "canonical_positions"),
    }

    def _positions(self) -> DataFrame:
        category = self.table("deal_facts").select("dataset", "deal_id", F.col("primary_direction").alias("category"))
        rows = stored(self.table("lines").join(category, ["dataset", "deal_id"]), "category_lines")
        return T.canonical_positions(rows, self.table("canonical_deals"), "category", self.as_of).drop("line")

    def table(self, name: str) -> DataFrame:
        """A fact table, written at its first use."""
        if name not in self._made:
            self._made[name] = stored(self._plans[name](), name, f"{self.folder}/{name}")
        return self._made[name]

    def run(self, scope: str = "all") -> dict[str, DataFrame]:
        scopes = self.SCOPES if scope == "all" else [scope]
        if scope != "all" and scope not in self.SCOPES:
            raise ValueError(f"scope is all or one of {sorted(self.SCOPES)}")
        return {name: self.table(name) for s in scopes for name in self.SCOPES[s]}

    def documents(self, types: tuple[str, ...] = ("product", "bundle", "deal_profile")) -> DataFrame:
        """(doc_id, doc_type, searchable_text) of the given types."""
        builders = {"product": self._products, "bundle": lambda: B.bundle_documents(self.table("bundle_facts"), self.table("template_matches")), "deal_profile": lambda: B.profile_documents(self.table("deal_profiles"))}
        if unknown := set(types) - set(builders):
            raise ValueError(f"no documents of type {sorted(unknown)}")
        out = None
        for kind in types:
            part = builders[kind]()
            out = part if out is None else out.unionByName(part)
        return out

    def _products(self) -> DataFrame:
        rows = self.table("product_facts").join(self.table("pricing").select("product_key", "recommended"), "product_key", "left")
        return B.as_documents(rows, "product", F.col("product_key"), P.search_text(F.col("product_name"), F.col("direction"), F.col("recommended")))

    def index(self, types: tuple[str, ...] = ("product", "bundle", "deal_profile"), previous: str | None = None) -> DataFrame:
        """Documents written as JSON lines and as an index; with a previous index only newer rows replace its own."""
        docs = stored(self.documents(types), "documents")
        write_documents(docs, f"{self.folder}/documents")
        write_index(docs, f"{self.folder}/index", previous)
        return docs.sparkSession.read.parquet(f"{self.folder}/index")
