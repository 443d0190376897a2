"""Declared table schemas, held as data.

A declaration is one string of column names in file order.  A bare name is a
double; ``name:s`` is a string and ``name:b`` a boolean, both of which are
indexed by frequency at import.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}


@dataclass(frozen=True)
class TableSchema:
    name: str
    struct: T.StructType
    label: str = "label"

    @classmethod
    def parse(cls, name: str, text: str, label: str = "label") -> TableSchema:
        fields = []
        for item in text.split():
            column, _, kind = item.partition(":")
            fields.append(T.StructField(column, _TYPES[kind or "d"], True))
        struct = T.StructType(fields)
        if len(set(struct.names)) != len(struct.names):
            raise ValueError(f"schema {name} repeats a column name")
        return cls(name, struct, label)

    @property
    def names(self) -> list[str]:
        return self.struct.names

    @property
    def raw(self) -> T.StructType:
        """The same names, every column a string: what the text holds."""
        return T.StructType([T.StructField(n, T.StringType(), True) for n in self.names])

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.struct if isinstance(f.dataType, T.DoubleType)]

    @property
    def indexed(self) -> list[str]:
        return [f.name for f in self.struct if not isinstance(f.dataType, T.DoubleType)]

    @property
    def encoded_order(self) -> list[str]:
        """Column order after import: numeric columns first, then indexed ones."""
        return self.numeric + self.indexed


# Column names, order and types of the supported data files.
_DECLARED = {
    "cleveland": """
        id ccf age sex painloc painexer relrest pncaden cp trestbps htn chol smoke cigs years
        fbs dm famhist restecg ekgmo ekgday ekgyr dig prop nitr pro diuretic proto thaldur
        thaltime met thalach thalrest tpeakbps tpeakbpd dum trestbpd exang xhypo oldpeak slope
        rldv5 rldv5e ca restckm exerckm restef restwm exeref exerwm thal thalsev thalpul
        earlobe cmo cday cyr label lmt ladprox laddist diag cxmain ramus om1 om2 rcaprox
        rcadist lvx1 lvx2 lvx3 lvx4 lvf cathef junk name:s""",
    "ann": "f1 "
    + " ".join(f"f{i}:b" for i in range(2, 17))
    + " "
    + " ".join(f"f{i}" for i in range(17, 22))
    + " label:s",
    "acs_16": """
        Age Sex DM HTA PriorPCI Hx_CHF Malignancy STEMI LVEF Hb_Admission Crea_Admission DES
        Revasc_Complete:s OAC BB PPI label""",
    "acs_26": """
        Age Sex DM HTA DLP PriorAMI PriorPCI PriorCABG Hx_Stroke Hx_CHF CKD:s Malignancy STEMI
        LVEF Hb_Admission Crea_Admission Multivessel DES Thrombolysis Revasc_Complete:s Clopi
        OAC BB ACEI_ARB Statin PPI label""",
    "acs_39_combined": """
        Age Sex DM HTA DLP PriorAMI PriorPCI PriorCABG Hx_Stroke Hx_CHF CKD:s Malignancy SU
        LVEF Hb_Admission Crea_Admission Multivessel DES Thrombolysis Revasc_Complete:s CTP
        OAC BB ACEI_ARB Statin PPI Killip2:s Transfusion_IH:s Bleeding_IH PAD HF_IH:s
        Continent:s Country:s Hx_Bleeding PCI_whithoutStent ReAMI_IH:s Ulcus:s Femoral_Access
        AAS label""",
    "acs_42": """
        Continent:s Country:s Age Sex DM HTA DLP PAD PriorAMI PriorPCI PriorCABG Hx_Stroke
        Hx_CHF:s CKD:s Ulcus:s Malignancy Hx_Bleeding STEMI UA Killip2:s LVEF Hb_Admission
        Crea_Admission Femoral_Access Multivessel DES PCI_whithoutStent Thrombolysis
        Revasc_Complete:s Bleeding_IH Transfusion_IH:s ReAMI_IH:s HF_IH:s AAS Clopi Tica Prasu
        OAC BB ACEI_ARB Statin PPI label""",
    "MACCE_d14": """
        年龄 有无DM:s 有无HT:s 有无脑血管病史:s 诊断:s 房颤扑:s LVEF WBC 中性 病变支数 重建类型:s
        有无LM病变:s 住院是否使用ASA:s 住院是否使用ACEI:s label""",
    "MACCE_d36": """
        男性:s 年龄 BMI（入院时） 有无DM:s 有无HT:s 有无脑血管病史:s 有无OMI:s 有无重建史:s
        有无吸烟史:s 诊断:s 稳定型CAD:s SBP DBP 房颤扑:s LVEF HBG WBC 中性 BUN CR TC TG LDL HDL
        空腹血糖 病变支数 左主干病变:s 重建类型:s 有无开口病变:s 有无LAD近端病变:s 有无LM病变:s
        住院是否使用ASA:s 住院是否使用β阻滞剂:s 住院是否使用钙拮抗剂:s 住院硝酸酯:s
        住院是否使用ACEI:s label""",
}


def declared_schemas() -> dict[str, TableSchema]:
    return {name: TableSchema.parse(name, text) for name, text in _DECLARED.items()}


def declared_schema(name: str) -> TableSchema:
    if name not in _DECLARED:
        raise KeyError(f"no schema named {name}; known: {sorted(_DECLARED)}")
    return TableSchema.parse(name, _DECLARED[name])
