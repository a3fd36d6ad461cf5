from .plans.runs import main

main()
