"""The sources that the library knows, by the headers of their tables."""

from __future__ import annotations

from .papers import Source

# The columns of each source, tried in order, and how it writes units.
_CURATED = {
    "nanozyme": ("Name", "name"), "mimic_enzyme_activity": ("Mimic enzyme activity", "mimic_enzyme_activity"), "shape": ("shape", "Shape"), "size_nm": ("Size/nm", "size_nm"), "dispersion_medium": ("Dispersion medium", "dispersion_medium"),
    "surface_modification": ("Surface modification", "surface_modification"), "buffer_ph_value": ("Buffer pH value", "Buffer pH"), "temperature_c": ("Temperature/℃", "temperature_c"), "substrate1": ("Substrate1 ", "substrate1"), "substrate2": ("Substrate2 ", "substrate2"),
    "Km_mM": ("Km/mM", "km_mM"), "Vmax_uM_s_minus1": ("Vmax/μM s-1", "vmax_uM_s"), "Kcat_s_minus1": ("Kcat/s-1 ", "Kcat/s-1", "kcat_s"), "catalytic_efficiency_M_s_minus1": ("k cat /Km\n(Catalytic efficiency )/M-1 s-1",), "doi": ("data reference doi", "doi"),
    "metal_type": ("Metal type", "metal_type"), "metal_ratio": ("Metal ratio", "metal_ratio"), "metal_valence": ("Metal valence", "metal_valence"), "doped_N": ("N",), "doped_P": ("P",), "doped_S": ("S",), "doped_B": ("B",), "doped_F": ("F",), "kinetic_substrate": ("Substrate1 ", "substrate1"),
}
CURATED = Source("human", _CURATED)
#: The curated table whose rows are all of one activity and need not name it.
CURATED_ONE = Source("human", _CURATED, activity="peroxidase")
AI_ZYMES = Source("db:ai-zymes", {
    "nanozyme": ("name",), "mimic_enzyme_activity": ("mimic_enzyme_activity",), "buffer_ph_value": ("buffer_ph_value",), "temperature_c": ("temperature",), "Km_mM": ("km_per_mm",), "Vmax_uM_s_minus1": ("vmax_micro_m_per_s",), "Kcat_s_minus1": ("kcat_per_s",),
    "substrate1": ("substrate1",), "substrate2": ("substrate2",), "kinetic_substrate": ("substrate1",), "doi": ("data_reference_doi",),
})
DIZYME = Source("db:dizyme", {
    "nanozyme": ("formula",), "mimic_enzyme_activity": ("activity",), "buffer_ph_value": ("ph",), "temperature_c": ("temp, °C",), "Km_mM": ("Km, mM",), "Vmax_uM_s_minus1": ("Vmax, mM/s",), "substrate1": ("ReactionType",), "doi": ("link",),
}, vmax_unit="mM/s", paired=True)
NANOZYME_NET_K = Source("db:nanozymenet-k", {
    "nanozyme": ("material",), "mimic_enzyme_activity": ("enzyme type",), "buffer_ph_value": ("pH",), "temperature_c": ("T",), "Km_mM": ("km",), "Vmax_uM_s_minus1": ("vmax",), "Kcat_s_minus1": ("kcat",), "substrate1": ("substrate",), "kinetic_substrate": ("substrate",),
}, exponents={"Km_mM": "km 10n", "Vmax_uM_s_minus1": "vmax 10n", "Kcat_s_minus1": "kcat 10n"})
NANOZYME_DB = Source("db:nanozymedb", {
    "nanozyme": ("Nanozyme Name/ Monomaterial",), "mimic_enzyme_activity": ("Enzyme Like Activity",), "buffer_ph_value": ("pH",), "temperature_c": ("Temp (℃)",), "Km_mM": ("Kₘ (mM)",), "Vmax_uM_s_minus1": ("Vmax(nM s⁻¹)",), "Kcat_s_minus1": ("kcat (s⁻¹)",),
    "substrate1": ("Substrate/Activity",), "kinetic_substrate": ("Substrate/Activity",), "doi": ("DOI",),
}, vmax_unit="?")
SOURCES = (CURATED, CURATED_ONE, AI_ZYMES, DIZYME, NANOZYME_NET_K, NANOZYME_DB)
