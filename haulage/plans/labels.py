"""Answer labels of the capacity questions.

# ---- fixed values: text returned to the user, must stay exactly as listed ----
"""

CAPACITY_FITS = "Appropriate orders according to capacity"
CAPACITY_DOES_NOT_FIT = "Orders not appropriate according to capacity"
OVER_CAPACITY = "Over capacity"
NEAR_CAPACITY = "Near capacity"
UNDER_CAPACITY = "Capacity larger than production"
NEAR_CAPACITY_SHARE = (9, 10)      # near capacity from utilisation 0.9 upwards
