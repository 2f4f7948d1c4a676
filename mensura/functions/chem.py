"""Chemistry adapters. They need RDKit and say so; nothing here imitates it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rdkit():
    try:
        import rdkit  # noqa: F401
        from rdkit import Chem
    except ImportError as e:
        raise RuntimeError("this adapter needs RDKit on every executor; use functions.text.largest_fragment without it") from e
    return Chem


def canonical(smiles: Column, tautomer: bool = False) -> Column:
    """struct<std_smiles, inchikey>: parent, neutral, optionally canonical tautomer; nulls where the text is no molecule."""
    _rdkit()

    @F.pandas_udf("std_smiles string, inchikey string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from rdkit import Chem
        from rdkit.Chem.MolStandardize import rdMolStandardize as std

        parent, neutral, tautomers = std.LargestFragmentChooser(), std.Uncharger(), std.TautomerEnumerator()
        for texts in batches:
            rows = []
            for text in texts:
                mol = Chem.MolFromSmiles(text) if text else None
                if mol is None:
                    rows.append((None, None))
                    continue
                mol = neutral.uncharge(parent.choose(std.Cleanup(mol)))
                mol = tautomers.Canonicalize(mol) if tautomer else mol
                rows.append((Chem.MolToSmiles(mol), Chem.MolToInchiKey(mol) or None))
            yield pd.DataFrame(rows, columns=["std_smiles", "inchikey"])

    return run(smiles)


def fingerprint(df: DataFrame, smiles: str = "std_smiles", radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """Adds on_bits, counts and scaffold ('' where none can be made)."""
    _rdkit()

    @F.pandas_udf("on_bits array<int>, counts array<int>, scaffold string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from rdkit import Chem
        from rdkit.Chem import rdFingerprintGenerator
        from rdkit.Chem.Scaffolds import MurckoScaffold

        maker = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=n_bits)
        for texts in batches:
            rows = []
            for text in texts:
                mol = Chem.MolFromSmiles(text)
                try:
                    scaffold = MurckoScaffold.MurckoScaffoldSmiles(mol=mol)
                except Exception:  # noqa: BLE001
                    scaffold = ""
                counted = maker.GetCountFingerprint(mol).GetNonzeroElements()
                rows.append((sorted(maker.GetFingerprint(mol).GetOnBits()), [counted[b] for b in sorted(counted)], scaffold))
            yield pd.DataFrame(rows, columns=["on_bits", "counts", "scaffold"])

    return df.withColumn("_f", run(F.col(smiles))).select(*df.columns, "_f.*")


def descriptors(df: DataFrame, smiles: str = "std_smiles") -> DataFrame:
    """Adds six physicochemical columns; without RDKit the table comes back as it is."""
    try:
        _rdkit()
    except RuntimeError:
        return df
    names = ["mol_wt", "log_p", "acceptors", "donors", "tpsa", "rotatable"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        from rdkit import Chem
        from rdkit.Chem import Crippen, Descriptors

        mols = [Chem.MolFromSmiles(t) for t in texts]
        makers = (Descriptors.MolWt, Crippen.MolLogP, Descriptors.NumHAcceptors, Descriptors.NumHDonors, Descriptors.TPSA, Descriptors.NumRotatableBonds)
        return pd.DataFrame([[float(f(m)) for f in makers] for m in mols], columns=names)

    return df.withColumn("_d", run(F.col(smiles))).select(*df.columns, "_d.*")
