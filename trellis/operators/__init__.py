"""Lazy DataFrame -> DataFrame operators, by survey id:

* ``prep``       U1 U2 P1-P5 P7-P10, loader (S1-S4)
* ``rank``       distributed running sums / ranks / lead (no single-task window)
* ``quantiles``  exact quantiles by distributed selection (A2)
* ``profile``    A1 A3-A11 A28
* ``split``      R1-R5 R7
* ``transform``  T1 T2
* ``preparation`` T1 T2 T4 R6 A11 inside a training part, for all folds at once
* ``metrics``    A12 A13 A19-A25 A27 M1
* ``curves``     A14-A18
* ``neighbours`` J4
* ``resample``   R6
* ``models``     M2-M9
* ``boosting``   M4, second order
* ``explain``    M10 M11
"""
