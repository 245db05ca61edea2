"""All tables of one data set, each built once and written to the shared work folder."""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from functools import cached_property, partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.operators import candidates as cand
from tillroll.operators import features as feat
from tillroll.operators import gates, models, rankers, recommend, rules, tables, validate
from tillroll.sources import mapping, raw
from tillroll.sources.store import Store, load_params

# The published rule limits (minimum orders, minimum pairs, minimum confidence).
PUBLISHED_LIMITS = (500, 100, 0.05)
# The limits of the registered queries and of their SQL, the same for all sizes of input. The test
# tables have a few hundred to a few hundred thousand orders; the published limits leave them no rule.
REGISTERED_LIMITS = (5, 3, 0.05)
# Rules that the registered queries count and don't stop on: one user of the skewed test data has more
# orders than the published data allow, and in a small catalogue a user can have bought nearly all of it.
REGISTERED_REPORT_ONLY = ("orders.order_number_fuera", "candidatos_nuevos.completos")
DEEPEST = 30
# the tables that are made from the ranking
BY_RANKING = ("ranking", "dos_bloques", "recomendaciones")


class Workspace:
    """Tables by name. Nothing runs until a table is asked for.

    `limits` are the minimum orders of an item, orders of a pair, and confidence of a rule.

    What is wrong with a table stops the build with `gates.BuildStopped` before the table can be read.
    `report_only` names rules (as table.control) that are counted only; `checks()` has all counts.
    `params` is where a search saved the parameters of boosting; without it the defaults are used.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        folder: str | None = None,
        limits: tuple[int, int, float] = PUBLISHED_LIMITS,
        report_only: Sequence[str] = (),
        params: str | None = None,
    ):
        self.spark = spark
        self.source = source
        self.limits = limits
        self.params = params
        self.report_only = frozenset(report_only)
        self.store = Store(spark, folder, gates.counts, partial(gates.require, skip=self.report_only))
        self._rank: Callable[[], DataFrame] | None = None
        self.made: dict[str, object] = {}  # what the registered queries share: paths, models

    @staticmethod
    def from_raw(spark: SparkSession, directory: str, max_rejected: int = 0, **how) -> RawWorkspace:
        """A workspace that starts from the six raw CSV files, see `RawWorkspace`."""
        return RawWorkspace(spark, directory, max_rejected=max_rejected, **how)

    def checks(self) -> DataFrame:
        """The rules of all tables built so far: tabla, control, construido, origen."""
        return gates.report(self.spark, self.store.observed)

    # raw tables ------------------------------------------------------------------------------

    @cached_property
    def _parts(self) -> DataFrame:
        return mapping.parts(self.spark, self.source)

    @cached_property
    def _lines(self) -> DataFrame:
        return self.store.table(
            "basket_lines", lambda: mapping.basket_lines(self.spark, self.source, self._parts)
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.store.table(
            "orders", lambda: mapping.orders(self.spark, self.source, self._lines)
        )

    @cached_property
    def _order_products(self) -> DataFrame:
        return self.store.table(
            "order_products",
            lambda: mapping.order_products(self._lines, self.orders),
            partition_by=["eval_set"],
        )

    @cached_property
    def prior(self) -> DataFrame:
        return self._order_products.where("eval_set = 'prior'").drop("eval_set")

    @cached_property
    def train(self) -> DataFrame:
        return self._order_products.where("eval_set = 'train'").drop("eval_set")

    @cached_property
    def products(self) -> DataFrame:
        return self.store.table("products", lambda: mapping.products(self._parts))

    @cached_property
    def aisles(self) -> DataFrame:
        return self.store.table("aisles", lambda: mapping.aisles(self._parts))

    @cached_property
    def departments(self) -> DataFrame:
        return self.store.table("departments", lambda: mapping.departments(self._parts))

    @property
    def raw(self) -> dict[str, DataFrame]:
        return {
            "orders": self.orders,
            "order_products_prior": self.prior,
            "order_products_train": self.train,
            "products": self.products,
            "aisles": self.aisles,
            "departments": self.departments,
        }

    # built tables ----------------------------------------------------------------------------

    @cached_property
    def catalog(self) -> DataFrame:
        return self.store.table(
            "catalogo", lambda: tables.catalog(self.products, self.aisles, self.departments)
        )

    @cached_property
    def catalog_size(self) -> Column:
        return self.catalog.agg(F.count(F.lit(1))).scalar()

    @cached_property
    def targets(self) -> DataFrame:
        return self.store.table(
            "targets_train", lambda: tables.targets(self.train, self.orders)
        )

    @cached_property
    def timeline(self) -> DataFrame:
        return self.store.table("order_timeline", lambda: tables.order_timeline(self.orders))

    @cached_property
    def pairs(self) -> DataFrame:
        known = self.store.observed.get("pair_history")
        table = self.store.table(
            "pair_history", lambda: tables.pair_history(self.prior, self.timeline, checks=True)
        )
        if known is None and self.store.observed["pair_history"]["sin_bit"]:
            self._require_distinct_lines()
        return table

    def _require_distinct_lines(self) -> None:
        """Repeated lines, counted by a job of its own: some orders have numbers that bits can't hold."""
        try:
            validate.require_zero(validate.surplus_rows(self.prior, ["order_id", "product_id"]), "order_products")
        except ValueError as e:
            self.store.forget("pair_history")
            raise gates.BuildStopped(str(e)) from None

    @cached_property
    def items(self) -> DataFrame:
        return self.store.table(
            "productos", lambda: tables.item_profile(self.catalog, self.pairs)
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.store.table(
            "usuarios", lambda: tables.user_profile(self.orders, self.pairs)
        )

    @cached_property
    def _interactions(self) -> DataFrame:
        return self.store.table(
            "interacciones",
            lambda: tables.interactions(self.pairs, self.catalog, with_cadence=True),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        return self._interactions.drop("cadencia_par")

    # features --------------------------------------------------------------------------------

    @cached_property
    def evaluable(self) -> DataFrame:
        return feat.evaluable_users(self.targets, self.users)

    @cached_property
    def split(self) -> DataFrame:
        return self.store.table("particion", lambda: feat.stratified_split(self.evaluable))

    @cached_property
    def features(self) -> DataFrame:
        return self.store.table(
            "features",
            lambda: feat.build_features(
                self._interactions, self.split, self.users, self.items,
                feat.target_context(self.orders, checks=True), feat.labels(self.targets),
                sort_by=["split", "user_id", "product_id"],
            ),
            partition_by=["split"],
        )

    @cached_property
    def new_features(self) -> DataFrame:
        return self.store.table(
            "variables_nuevas",
            lambda: feat.recent_window_features(
                self.pairs, self.catalog, feat.aisle_affinity(self.pairs, self.catalog)
            ),
        )

    def part(self, split: str) -> DataFrame:
        return self.features.where(F.col("split") == split)

    # evaluation inputs -----------------------------------------------------------------------

    @cached_property
    def all_truth(self) -> DataFrame:
        return rankers.truth(self.targets)

    @cached_property
    def valid_users(self) -> DataFrame:
        return self.split.where("split = 'valid'").select("user_id")

    @cached_property
    def truth(self) -> DataFrame:
        """Target items of the validation users."""
        return self.store.table("verdad", lambda: rankers.truth(self.targets, self.valid_users))

    @cached_property
    def history(self) -> DataFrame:
        """History items of the validation users."""
        return self.store.table(
            "historial", lambda: rankers.history(self.interactions, self.valid_users)
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self.split.where("split = 'valid'").select(
            "user_id", F.col("segmento_usuario").alias("segmento")
        )

    @cached_property
    def ranking(self) -> DataFrame:
        """Validation ranking, deep enough for every list length in use; of the heuristic if no other is given."""
        return self.store.table("ranking", self._rank or self._rank_by_heuristic)

    def _rank_by_heuristic(self) -> DataFrame:
        return rankers.topk(self.part("valid"), rankers.heuristic_score(), DEEPEST)

    def with_ranking(self, rank: Callable[[], DataFrame]) -> Workspace:
        """The same tables with another ranking (user_id, product_id, rank) and what is made from it."""
        other = copy.copy(self)
        for name in ("ranking", "top10", "two_block"):
            other.__dict__.pop(name, None)
        other.store, other.made, other._rank = self.store.branch(BY_RANKING), {}, rank
        return other

    @cached_property
    def boosting(self) -> tuple[PipelineModel, dict[str, float]]:
        """Boosting trained on the train users, and the medians it imputes with."""
        return models.train_boosting(
            self.part("train"), params=self.boosting_params()[0],
            keep=lambda df: self.store.table("filas_de_ajuste", lambda: df),
        )

    @cached_property
    def trained(self) -> Workspace:
        """This workspace with the ranking of the trained model."""
        def rank() -> DataFrame:
            return rankers.topk(models.score_boosting(*self.boosting, self.part("valid")), "score", DEEPEST)

        return self.with_ranking(rank)

    @cached_property
    def top10(self) -> DataFrame:
        return self.ranking.where("rank <= 10")

    def boosting_params(self) -> tuple[dict, str]:
        """The parameters that boosting is trained with, and where they come from."""
        if self.params is None:
            return dict(models.BOOSTING), "default"
        return load_params(self.spark, self.params, models.BOOSTING)

    # rules -----------------------------------------------------------------------------------

    @cached_property
    def basket_total(self) -> Column:
        return rules.basket_total(self.prior).scalar()

    @cached_property
    def support(self) -> DataFrame:
        return self.store.table("soporte", lambda: rules.support(self.prior, self.limits[0]))

    @cached_property
    def pair_counts(self) -> DataFrame:
        return self.store.table(
            "pares",
            lambda: rules.pair_counts(
                rules.prune_baskets(self.prior, self.support), "product_id", self.limits[1]
            ),
        )

    @cached_property
    def rules(self) -> DataFrame:
        """Directed rules with unrounded strength."""
        return self.store.table(
            "reglas_dirigidas",
            lambda: rules.directed_rules(
                self.pair_counts, self.support, self.catalog, self.basket_total, self.limits[2]
            ),
        )

    @cached_property
    def published_rules(self) -> DataFrame:
        return self.store.table("reglas", lambda: rules.complementary(self.rules))

    @cached_property
    def rule_index(self) -> DataFrame:
        return self.store.table("indice_reglas", lambda: rules.rule_index(self.published_rules))

    @cached_property
    def suggestions(self) -> DataFrame:
        """Up to 8 new items per validation user."""
        return self.store.table(
            "sugerencias",
            lambda: recommend.novelty_suggestions(self.history, self.rule_index, 8),
        )

    @cached_property
    def two_block(self) -> DataFrame:
        return self.store.table(
            "dos_bloques",
            lambda: recommend.two_block(
                self.top10, self.history, self.segments, self.rule_index
            ),
        )

    # candidates ------------------------------------------------------------------------------

    @cached_property
    def ranked_items(self) -> DataFrame:
        return self.store.table(
            "productos_rank", lambda: cand.rank_items(cand.item_score(self.items))
        )

    @cached_property
    def affinities(self) -> DataFrame:
        return self.store.table("afinidades", lambda: cand.affinities(self.interactions))

    @cached_property
    def preselected(self) -> DataFrame:
        return self.store.table(
            "candidatos_pre",
            lambda: cand.union_sources(
                cand.preselect_aisle(self.affinities, self.ranked_items),
                cand.preselect_department(self.affinities, self.ranked_items),
                cand.preselect_global(self.users, self.ranked_items),
            ),
        )

    @cached_property
    def unique_candidates(self) -> DataFrame:
        return self.store.table(
            "candidatos_unicos",
            lambda: cand.new_and_deduped(
                self.preselected, self.interactions, self.preselected.count() + self.interactions.count()
            ),
        )

    @cached_property
    def quotas(self) -> DataFrame:
        return cand.quota(self.users, self.unique_candidates)

    @cached_property
    def fallback(self) -> DataFrame:
        return cand.fallback(
            self.quotas, self.ranked_items, self.unique_candidates, self.interactions
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.store.table(
            "candidatos_nuevos",
            lambda: cand.final_candidates(self.unique_candidates, self.fallback, self.users, checks=True),
        )

    @cached_property
    def baseline_by_count(self) -> DataFrame:
        return self.store.table(
            "baseline",
            lambda: rankers.repurchase_topk_by_count(
                self.interactions, self.targets.select("user_id").distinct()
            ),
        )


class RawWorkspace(Workspace):
    """A workspace over the six raw CSV files of a folder.

    The headers are read first: a missing file or column stops everything, named by table. Each file is
    then parsed once into a typed table. Lines that don't fit the types or the number of columns go into
    a part of their own; more than `max_rejected` of them in all stop the build, fewer are in `rejected`.
    """

    def __init__(self, spark: SparkSession, source: str, max_rejected: int = 0, **how):
        super().__init__(spark, source, **how)
        self.max_rejected = max_rejected
        self._csv = raw.read_checked(spark, source)

    @cached_property
    def _typed(self) -> dict[str, DataFrame]:
        """The parsed tables with their rejected lines as a partition."""
        out = {
            name: self.store.table(f"raw_{name}", lambda df=df: df, partition_by=["_rechazada"])
            for name, df in self._csv.items()
        }
        bad = {n: self.store.observed[f"raw_{n}"]["rechazadas"] for n in out}
        if sum(bad.values()) > self.max_rejected:
            few = [line for n, df in out.items() if bad[n] for line in raw.sample_of_rejected(df)]
            raise gates.BuildStopped(
                "rejected lines: " + "; ".join(f"{n}: {k}" for n, k in bad.items() if k) + "; such as " + repr(few)
            )
        lines = {t: self.store.observed[f"raw_order_products_{t}"] for t in ("prior", "train")}
        seen = {t: counted["aceptadas"] for t, counted in lines.items()}
        for rule in gates.RULES["order_products"]:
            seen[rule] = sum(counted[rule] for counted in lines.values())
        gates.require("order_products", {"order_products": seen}, self.report_only)
        self.store.observed["order_products"] = seen
        return out

    def _accepted(self, name: str) -> DataFrame:
        return self._typed[name].where("NOT _rechazada").drop("_rechazada", "linea")

    @cached_property
    def rejected(self) -> DataFrame:
        """The lines that could not be read: tabla, linea."""
        out = None
        for name, df in self._typed.items():
            bad = df.where("_rechazada").select(F.lit(name).alias("tabla"), "linea")
            out = bad if out is None else out.unionByName(bad)
        return out

    def rejected_counts(self) -> DataFrame:
        """tabla, aceptadas, rechazadas, counted while the files were parsed."""
        rows = [
            (n, self.store.observed[f"raw_{n}"]["aceptadas"], self.store.observed[f"raw_{n}"]["rechazadas"])
            for n in self._typed
        ]
        return self.spark.createDataFrame(rows, "tabla STRING, aceptadas BIGINT, rechazadas BIGINT")

    def _with_repeats(self, name: str) -> DataFrame:
        """Rows beyond the first of a key are marked for the check."""
        key = validate.KEYS[name]
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
        return self._accepted(name).withColumn("_repetida", nth > 1)

    @cached_property
    def orders(self) -> DataFrame:
        return self.store.table("orders", lambda: self._with_repeats("orders"))

    @cached_property
    def prior(self) -> DataFrame:
        return self._accepted("order_products_prior")

    @cached_property
    def train(self) -> DataFrame:
        return self._accepted("order_products_train")

    @cached_property
    def products(self) -> DataFrame:
        return self.store.table("products", lambda: self._with_repeats("products"))

    @cached_property
    def aisles(self) -> DataFrame:
        return self._accepted("aisles")

    @cached_property
    def departments(self) -> DataFrame:
        return self._accepted("departments")


# One workspace per application and data set, so that queries share the tables they need.
_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, source: str) -> Workspace:
    """The workspace of this application and data set."""
    key = (spark.sparkContext.applicationId, source.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, key[1], limits=REGISTERED_LIMITS, report_only=REGISTERED_REPORT_ONLY)
    return _OPEN[key]
