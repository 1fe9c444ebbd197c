"""The catalogue of spectral indices: published formulas over band parameters."""

from __future__ import annotations

#: The usual constants of the formulas.
CONSTANTS = {"L": 0.5, "g": 2.5, "C1": 6.0, "C2": 7.5, "cexp": 1.16, "nexp": 2.0, "alpha": 0.1, "sla": 1.0, "slb": 0.0, "gamma": 1.0, "omega": 2.0, "k": 0.0, "beta": 0.05, "epsilon": 1.0, "fdelta": 0.581}
#: The formulas of the named indices as they were published. B, G, R: blue, green, red; RE1 to RE3: red edge; N: near infrared; S1, S2: short-wave infrared.
FORMULAS = {
    # Vegetation
    "AFRI1600": "(N - 0.66 * S1) / (N + 0.66 * S1)",
    "AFRI2100": "(N - 0.5 * S2) / (N + 0.5 * S2)",
    "ARI": "1 / G - 1 / RE1",
    "ARI2": "N * (1 / G - 1 / RE1)",
    "ARVI": "(N - (R - gamma * (R - B))) / (N + (R - gamma * (R - B)))",
    "ATSAVI": "sla * (N - sla * R - slb) / (sla * N + R - sla * slb + 0.08 * (1 + sla ** 2))",
    "AVI": "(N * (1 - R) * (N - R)) ** (1 / 3)",
    "BCC": "B / (R + G + B)",
    "BNDVI": "(N - B) / (N + B)",
    "BWDRVI": "(alpha * N - B) / (alpha * N + B)",
    "CIG": "N / G - 1",
    "CIRE": "N / RE1 - 1",
    "CRI550": "1 / B - 1 / G",
    "CRI700": "1 / B - 1 / RE1",
    "CVI": "N * R / G ** 2",
    "DSI": "S1 / N",
    "DSWI1": "N / S1",
    "DSWI2": "S1 / G",
    "DSWI3": "S1 / R",
    "DSWI4": "G / R",
    "DSWI5": "(N + G) / (S1 + R)",
    "DVI": "N - R",
    "EBI": "(R + G + B) / ((G / B) * (R - B + epsilon))",
    "EVI": "g * (N - R) / (N + C1 * R - C2 * B + L)",
    "EVI2": "g * (N - R) / (N + 2.4 * R + L)",
    "ExG": "2 * G - R - B",
    "ExGR": "(2 * G - R - B) - (1.3 * R - G)",
    "ExR": "1.3 * R - G",
    "FCVI": "N - (R + G + B) / 3",
    "GARI": "(N - (G - (B - R))) / (N - (G + (B - R)))",
    "GBNDVI": "(N - (G + B)) / (N + (G + B))",
    "GCC": "G / (R + G + B)",
    "GDVI": "(N ** nexp - R ** nexp) / (N ** nexp + R ** nexp)",
    "GEMI": "((2 * (N ** 2 - R ** 2) + 1.5 * N + 0.5 * R) / (N + R + 0.5)) * (1 - 0.25 * ((2 * (N ** 2 - R ** 2) + 1.5 * N + 0.5 * R) / (N + R + 0.5))) - (R - 0.125) / (1 - R)",
    "GLI": "(2 * G - R - B) / (2 * G + R + B)",
    "GM1": "RE2 / G",
    "GM2": "RE2 / RE1",
    "GNDVI": "(N - G) / (N + G)",
    "GOSAVI": "(N - G) / (N + G + 0.16)",
    "GRNDVI": "(N - (G + R)) / (N + (G + R))",
    "GRVI": "N / G",
    "GSAVI": "(1 + L) * (N - G) / (N + G + L)",
    "GVMI": "((N + 0.1) - (S2 + 0.02)) / ((N + 0.1) + (S2 + 0.02))",
    "IAVI": "(N - (R - gamma * (B - R))) / (N + (R - gamma * (B - R)))",
    "IKAW": "(R - B) / (R + B)",
    "IPVI": "N / (N + R)",
    "IRECI": "(RE3 - R) / (RE1 / RE2)",
    "MCARI": "((RE1 - R) - 0.2 * (RE1 - G)) * (RE1 / R)",
    "MCARI1": "1.2 * (2.5 * (N - R) - 1.3 * (N - G))",
    "MCARI2": "(1.5 * (2.5 * (N - R) - 1.3 * (N - G))) / ((((2 * N + 1) ** 2) - (6 * N - 5 * (R ** 0.5)) - 0.5) ** 0.5)",
    "MCARI705": "((RE2 - RE1) - 0.2 * (RE2 - G)) * (RE2 / RE1)",
    "MCARIOSAVI": "(((RE1 - R) - 0.2 * (RE1 - G)) * (RE1 / R)) / (1.16 * (N - R) / (N + R + 0.16))",
    "MGRVI": "(G ** 2 - R ** 2) / (G ** 2 + R ** 2)",
    "MNLI": "(1 + L) * (N ** 2 - R) / (N ** 2 + R + L)",
    "MRBVI": "(R ** 2 - B ** 2) / (R ** 2 + B ** 2)",
    "MSAVI": "0.5 * (2 * N + 1 - (((2 * N + 1) ** 2) - 8 * (N - R)) ** 0.5)",
    "MSI": "S1 / N",
    "MSR": "(N / R - 1) / ((N / R + 1) ** 0.5)",
    "MSR705": "(RE2 / RE1 - 1) / ((RE2 / RE1 + 1) ** 0.5)",
    "MTCI": "(RE2 - RE1) / (RE1 - R)",
    "MTVI1": "1.2 * (1.2 * (N - G) - 2.5 * (R - G))",
    "MTVI2": "(1.5 * (1.2 * (N - G) - 2.5 * (R - G))) / ((((2 * N + 1) ** 2) - (6 * N - 5 * (R ** 0.5)) - 0.5) ** 0.5)",
    "ND705": "(RE2 - RE1) / (RE2 + RE1)",
    "NDDI": "((N - R) / (N + R) - (G - N) / (G + N)) / ((N - R) / (N + R) + (G - N) / (G + N))",
    "NDGI": "(G - R) / (G + R)",
    "NDII": "(N - S1) / (N + S1)",
    "NDMI": "(N - S1) / (N + S1)",
    "NDPI": "(N - (0.74 * R + 0.26 * S1)) / (N + (0.74 * R + 0.26 * S1))",
    "NDRE": "(N - RE1) / (N + RE1)",
    "NDREI": "(N - RE1) / (N + RE1)",
    "NDVI": "(N - R) / (N + R)",
    "NDVI705": "(RE2 - RE1) / (RE2 + RE1)",
    "NDYI": "(G - B) / (G + B)",
    "NGRDI": "(G - R) / (G + R)",
    "NIRv": "((N - R) / (N + R)) * N",
    "NLI": "(N ** 2 - R) / (N ** 2 + R)",
    "NMDI": "(N - (S1 - S2)) / (N + (S1 - S2))",
    "NRFIg": "(G - S2) / (G + S2)",
    "NRFIr": "(R - S2) / (R + S2)",
    "NormG": "G / (N + G + R)",
    "NormNIR": "N / (N + G + R)",
    "NormR": "R / (N + G + R)",
    "OSAVI": "(N - R) / (N + R + 0.16)",
    "PSRI": "(R - B) / RE2",
    "RCC": "R / (R + G + B)",
    "RDVI": "(N - R) / ((N + R) ** 0.5)",
    "REDSI": "((705 - 665) * (RE3 - R) - (783 - 665) * (RE1 - R)) / (2 * R)",
    "RENDVI": "(RE2 - RE1) / (RE2 + RE1)",
    "RGBVI": "(G ** 2 - B * R) / (G ** 2 + B * R)",
    "RGRI": "R / G",
    "RI": "(R - G) / (R + G)",
    "RVI": "RE2 / R",
    "S2REP": "705 + 35 * ((((RE3 + R) / 2) - RE1) / (RE2 - RE1))",
    "S2WI": "(RE1 - S2) / (RE1 + S2)",
    "SARVI": "(1 + L) * (N - (R - (R - B))) / (N + (R - (R - B)) + L)",
    "SAVI": "(1 + L) * (N - R) / (N + R + L)",
    "SAVI2": "N / (R + slb / sla)",
    "SEVI": "N / R + fdelta * (1 / R)",
    "SIPI": "(N - B) / (N - R)",
    "SLAVI": "N / (R + S2)",
    "SR": "N / R",
    "SR2": "N / G",
    "SR555": "RE2 / G",
    "SR705": "RE2 / RE1",
    "SeLI": "(RE3 - RE1) / (RE3 + RE1)",
    "TCARI": "3 * ((RE1 - R) - 0.2 * (RE1 - G) * (RE1 / R))",
    "TCARIOSAVI": "(3 * ((RE1 - R) - 0.2 * (RE1 - G) * (RE1 / R))) / (1.16 * (N - R) / (N + R + 0.16))",
    "TCI": "1.2 * (RE1 - G) - 1.5 * (R - G) * (RE1 / R) ** 0.5",
    "TDVI": "1.5 * (N - R) / ((N ** 2 + R + 0.5) ** 0.5)",
    "TGI": "-0.5 * (190 * (R - G) - 120 * (R - B))",
    "TRRVI": "((RE2 - R) / (RE2 + R)) / ((N - R) / (N + R) + 1)",
    "TSAVI": "sla * (N - sla * R - slb) / (sla * N + R - sla * slb)",
    "TTVI": "0.5 * ((783 - 740) * (RE3 - RE2) - (783 - 705) * (RE2 - RE1))",
    "TVI": "((N - R) / (N + R) + 0.5) ** 0.5",
    "TriVI": "0.5 * (120 * (N - G) - 200 * (R - G))",
    "VARI": "(G - R) / (G + R - B)",
    "VARI700": "(RE1 - 1.7 * R + 0.7 * B) / (RE1 + 1.3 * R - 1.3 * B)",
    "VI700": "(RE1 - R) / (RE1 + R)",
    "VIG": "(G - R) / (G + R)",
    "WDRVI": "(alpha * N - R) / (alpha * N + R)",
    "WDVI": "N - sla * R",
    "mND705": "(RE2 - RE1) / (RE2 + RE1 - B)",
    "mSR705B": "(RE2 - B) / (RE1 - B)",
    # Water
    "ANDWI": "(B + G + R - N - S1 - S2) / (B + G + R + N + S1 + S2)",
    "AWEInsh": "4 * (G - S1) - 0.25 * N + 2.75 * S2",
    "AWEIsh": "B + 2.5 * G - 1.5 * (N + S1) - 0.25 * S2",
    "FAI": "N - (R + (S1 - R) * ((842 - 665) / (1610 - 665)))",
    "LSWI": "(N - S1) / (N + S1)",
    "MBWI": "omega * G - R - N - S1 - S2",
    "MLSWI26": "(1 - N - S1) / (1 - N + S1)",
    "MLSWI27": "(1 - N - S2) / (1 - N + S2)",
    "MNDWI": "(G - S1) / (G + S1)",
    "MuWIR": "-4 * ((B - G) / (B + G)) + 2 * ((G - N) / (G + N)) + 2 * ((G - S2) / (G + S2)) - (G - S1) / (G + S1)",
    "NDCI": "(RE1 - R) / (RE1 + R)",
    "NDPonI": "(S1 - G) / (S1 + G)",
    "NDTI": "(R - G) / (R + G)",
    "NDVIMNDWI": "(N - R) / (N + R) - (G - S1) / (G + S1)",
    "NDWI": "(G - N) / (G + N)",
    "NDWIns": "(G - alpha * N) / (G + N)",
    "OSI": "(G + R) / B",
    "PI": "N / (N + R)",
    "RNDVI": "(R - N) / (R + N)",
    "SWM": "(B + G) / (N + S1)",
    "TWI2015": "1.7204 + 171 * G + 3 * R - 70 * N - 45 * S1 - 71 * S2",
    "WI1": "(G - S2) / (G + S2)",
    "WI2": "(B - S2) / (B + S2)",
    "WI2015": "1.7204 + 171 * G + 3 * R - 70 * N - 45 * S1 - 71 * S2",
    "WRI": "(G + R) / (N + S1)",
    # Burn
    "BAI": "1 / ((0.1 - R) ** 2 + (0.06 - N) ** 2)",
    "BAIM": "1 / ((0.05 - N) ** 2 + (0.2 - S2) ** 2)",
    "BAIS2": "(1 - ((RE2 * RE3 * N) / R) ** 0.5) * ((S2 - N) / ((S2 + N) ** 0.5) + 1)",
    "CSI": "N / S2",
    "MIRBI": "10 * S2 - 9.8 * S1 + 2",
    "NBR": "(N - S2) / (N + S2)",
    "NBR2": "(S1 - S2) / (S1 + S2)",
    "NBRSWIR": "(S2 - S1 - 0.02) / (S2 + S1 + 0.1)",
    "NBRplus": "(S2 - N - G - B) / (S2 + N + G + B)",
    "NDSWIR": "(N - S1) / (N + S1)",
    "NSTv1": "((N - S2) / (N + S2)) * S1",
    # Snow, soil, built-up
    "NBSIMS": "0.36 * (G + R + N) - ((B + S2) / G + S1)",
    "NDGlaI": "(G - R) / (G + R)",
    "NDSI": "(G - S1) / (G + S1)",
    "NDSII": "(G - N) / (G + N)",
    "NDSInw": "(N - S1 - beta) / (N + S1)",
    "S3": "N * (R - S1) / ((N + R) * (N + S1))",
    "SWI": "G * (N - S1) / ((G + N) * (N + S1))",
    "BI": "((S1 + R) - (N + B)) / ((S1 + R) + (N + B))",
    "BITM": "((B ** 2 + G ** 2 + R ** 2) / 3) ** 0.5",
    "BIXS": "((G ** 2 + R ** 2) / 2) ** 0.5",
    "BSI": "((S1 + R) - (N + B)) / ((S1 + R) + (N + B))",
    "BareI": "R + S1 - N",
    "EMBI": "((S1 - S2 - N) / (S1 + S2 + N) + 0.5 - (G - S1) / (G + S1) - 0.5) / ((S1 - S2 - N) / (S1 + S2 + N) + 0.5 + (G - S1) / (G + S1) + 1.5)",
    "MBI": "(S1 - S2 - N) / (S1 + S2 + N) + 0.5",
    "NBLI": "(R - S1) / (R + S1)",
    "NDSoI": "(S2 - G) / (S2 + G)",
    "NSDS": "(S1 - S2) / (S1 + S2)",
    "RI4XS": "R ** 2 / G ** 4",
    "BLFEI": "((G + R + S2) / 3 - S1) / ((G + R + S2) / 3 + S1)",
    "BRBA": "R / S1",
    "IBI": "((S1 - N) / (S1 + N) - ((N - R) * (1 + L) / (N + R + L) + (G - S1) / (G + S1)) / 2) / ((S1 - N) / (S1 + N) + ((N - R) * (1 + L) / (N + R + L) + (G - S1) / (G + S1)) / 2)",
    "NBAI": "(S2 - S1 / G) / (S2 + S1 / G)",
    "NBUI": "((S1 - N) / (S1 + N)) - ((N - R) * (1 + L) / (N + R + L)) - (G - S1) / (G + S1)",
    "NDBI": "(S1 - N) / (S1 + N)",
    "PISI": "0.8192 * B - 0.5735 * N + 0.075",
    "UI": "(S2 - N) / (S2 + N)",
    "VIBI": "((N - R) / (N + R)) / ((N - R) / (N + R) + (S1 - N) / (S1 + N))",
    "VgNIRBI": "(G - N) / (G + N)",
    "VrNIRBI": "(R - N) / (R + N)",
}
