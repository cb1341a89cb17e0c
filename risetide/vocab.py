"""Stop-word lists."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------------
TOPIC_STOPWORDS = """
a an the and or but in on at to for of
with by from as is was are were be been
news says say said year years day days new
first one two last time people world u s
nan none apparently reveals freaks prices underground
get got gets make made makes take took takes
see saw sees know knew knows think thought thinks
like just also even back into than when what
how why who which this that these those it
week series private lectures
""".split()

KEYWORD_STOPWORDS = """
a an the and or but in on at to for of
with by from as is was are were be been
being have has had do does did will would
could should may might must shall can need
dare ought used up out over after before
news live updates update breaking latest report
""".split()

# The common English function-word list used for ranked key phrases.
RAKE_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
# ----------------------------------------------------------------------------------
