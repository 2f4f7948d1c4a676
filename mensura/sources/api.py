"""Paged web source as a Spark data source: one partition per (gene, target), retried inside the task."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "molecule_chembl_id,canonical_smiles,pchembl_value,standard_type,document_year,assay_chembl_id"


def retried(call: Callable[[], object], what: str, tries: int = 6, base: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call until it works, waiting base, 2 base, 4 base ... seconds between; raise with the last error after ``tries``."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            last = e
            if n + 1 < tries:
                sleep(base * 2**n)
    raise RuntimeError(f"{what}: failed after {tries} tries: {last}")


def fetch(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return json.loads(answer.read())


class TargetPartition(InputPartition):
    def __init__(self, gene: str, target: str):
        self.gene, self.target = gene, target


class ActivityReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Callable[[str], dict] = fetch):
        self.base, self.endpoint, self.get = options["base"].rstrip("/"), options["endpoint"], get
        self.pace = float(options.get("pace", "0.2"))
        self.targets: dict[str, list[str]] = json.loads(options["targets"])

    def partitions(self) -> list[InputPartition]:
        return [TargetPartition(g, t) for g in sorted(self.targets) for t in sorted(set(self.targets[g]))]

    def read(self, partition: TargetPartition) -> Iterator[tuple]:
        query = {"target_chembl_id": partition.target, "standard_type": self.endpoint, "standard_relation": "=", "pchembl_value__isnull": "false", "only": FIELDS, "limit": "1000", "format": "json"}
        url = f"{self.base}/activity?{urllib.parse.urlencode(query)}"
        while url:
            page = retried(lambda u=url: self.get(u), f"activities {partition.gene}/{partition.target}")
            for r in page["activities"]:
                if r.get("canonical_smiles"):
                    year = r.get("document_year")
                    yield (partition.gene, partition.target, r["molecule_chembl_id"], r["canonical_smiles"], float(r["pchembl_value"]), r["standard_type"], int(year) if year else None, r.get("assay_chembl_id"))
            more = (page.get("page_meta") or {}).get("next")
            url = urllib.parse.urljoin(self.base + "/", more) if more else None
            time.sleep(self.pace)


class ActivitySource(DataSource):
    """``spark.dataSource.register(ActivitySource)``; options base, endpoint, targets (JSON: gene -> target ids), pace."""

    @classmethod
    def name(cls) -> str:
        return "activities"

    def schema(self) -> str:
        return "gene string, target_chembl_id string, mol_id string, smiles string, pchembl double, endpoint string, year int, assay_id string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ActivityReader(self.options)


def resolve_targets(base: str, family: dict[str, str], get: Callable[[str], dict] = fetch) -> dict[str, list[str]]:
    """gene -> sorted distinct single-protein target ids of its accession."""
    out = {}
    for gene, accession in family.items():
        query = urllib.parse.urlencode({"target_components__accession": accession, "target_type": "SINGLE PROTEIN", "only": "target_chembl_id", "format": "json"})
        page = retried(lambda q=query: get(f"{base.rstrip('/')}/target?{q}"), f"resolve {gene}")
        out[gene] = sorted({t["target_chembl_id"] for t in page["targets"]})
    return out
