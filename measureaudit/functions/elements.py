"""Chemical elements: what the readers and the models know of them."""

from __future__ import annotations

# Electronegativity and mass that the models take for a metal, by symbol.
ATTRIBUTES = {
    "H": (2.20, 1.0), "Li": (0.98, 6.9), "B": (2.04, 10.8), "C": (2.55, 12.0), "N": (3.04, 14.0), "O": (3.44, 16.0), "F": (3.98, 19.0), "Na": (0.93, 23.0),
    "Mg": (1.31, 24.3), "Al": (1.61, 27.0), "Si": (1.90, 28.1), "P": (2.19, 31.0), "S": (2.58, 32.1), "Cl": (3.16, 35.5), "K": (0.82, 39.1), "Ca": (1.00, 40.1),
    "Sc": (1.36, 45.0), "Ti": (1.54, 47.9), "V": (1.63, 50.9), "Cr": (1.66, 52.0), "Mn": (1.55, 54.9), "Fe": (1.83, 55.8), "Co": (1.88, 58.9), "Ni": (1.91, 58.7),
    "Cu": (1.90, 63.5), "Zn": (1.65, 65.4), "Se": (2.55, 79.0), "Sr": (0.95, 87.6), "Y": (1.22, 88.9), "Zr": (1.33, 91.2), "Nb": (1.6, 92.9), "Mo": (2.16, 95.9),
    "Ru": (2.2, 101.1), "Rh": (2.28, 102.9), "Pd": (2.20, 106.4), "Ag": (1.93, 107.9), "Cd": (1.69, 112.4), "In": (1.78, 114.8), "Sn": (1.96, 118.7), "Sb": (2.05, 121.8),
    "Te": (2.1, 127.6), "Ba": (0.89, 137.3), "La": (1.10, 138.9), "Ce": (1.12, 140.1), "Pr": (1.13, 140.9), "Nd": (1.14, 144.2), "Sm": (1.17, 150.4), "Eu": (1.2, 152.0),
    "Gd": (1.20, 157.3), "Ho": (1.23, 164.9), "Er": (1.24, 167.3), "Tm": (1.25, 168.9), "Yb": (1.1, 173.0), "Lu": (1.27, 175.0), "Hf": (1.3, 178.5), "Ta": (1.5, 180.9),
    "W": (2.36, 183.8), "Re": (1.9, 186.2), "Os": (2.2, 190.2), "Ir": (2.20, 192.2), "Pt": (2.28, 195.1), "Au": (2.54, 197.0), "Bi": (2.02, 209.0),
}
#: What stands for a metal that ATTRIBUTES lacks.
OTHER = (1.8, 100.0)

# The elements that a source may give by number.
NUMBERS = {
    1: "H", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 11: "Na", 12: "Mg", 13: "Al", 14: "Si", 15: "P", 16: "S", 17: "Cl", 19: "K", 20: "Ca", 22: "Ti", 23: "V", 24: "Cr", 25: "Mn", 26: "Fe",
    27: "Co", 28: "Ni", 29: "Cu", 30: "Zn", 31: "Ga", 32: "Ge", 33: "As", 34: "Se", 35: "Br", 38: "Sr", 39: "Y", 40: "Zr", 41: "Nb", 42: "Mo", 44: "Ru", 45: "Rh", 46: "Pd", 47: "Ag",
    48: "Cd", 49: "In", 50: "Sn", 51: "Sb", 52: "Te", 53: "I", 55: "Cs", 56: "Ba", 57: "La", 58: "Ce", 59: "Pr", 60: "Nd", 62: "Sm", 63: "Eu", 64: "Gd", 65: "Tb", 66: "Dy", 67: "Ho",
    68: "Er", 69: "Tm", 70: "Yb", 71: "Lu", 72: "Hf", 73: "Ta", 74: "W", 75: "Re", 76: "Os", 77: "Ir", 78: "Pt", 79: "Au", 80: "Hg", 81: "Tl", 82: "Pb", 83: "Bi", 90: "Th", 92: "U",
}
